"""Keyed state that starts from history: live features and ticker status on ``transformWithState``.

Both need the RocksDB state store (``use_rocksdb``), which keeps state on disk and hands tasks one key at a
time. State per ticker is bounded: 50 bars for features, 51 bar starts and one tick for the status.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.features import (
    LIVE_BUFFER_BARS, LIVE_MIN_BARS, MOMENTUM_BARS, RETURN_BARS, VOLATILITY_BARS, ZSCORE_MIN_BARS,
)
from ..schema import FEATURE_NAMES
from .live import VECTORS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STATUS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("tick_count", T.LongType()),
        T.StructField("last_price", T.DoubleType()),
        T.StructField("last_volume", T.DoubleType()),
        T.StructField("last_update", T.TimestampType()),
        T.StructField("bars_accumulated", T.LongType()),
        T.StructField("features_ready", T.BooleanType()),
    ]
)


def use_rocksdb(spark: SparkSession) -> None:
    """State store of the streams started from here on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


def vectors_after(closes: np.ndarray, volumes: np.ndarray, old: int) -> pd.DataFrame:
    """The four live features of every bar from position ``old`` on; NaN where a value is absent."""
    close, volume = pd.Series(closes), pd.Series(volumes)
    log_return = np.log(close.where(close > 0)).diff()
    buffer = volume.rolling(LIVE_BUFFER_BARS, min_periods=ZSCORE_MIN_BARS)
    spread = buffer.std()
    month, fortnight = (close.shift(n).replace(0.0, np.nan) for n in (RETURN_BARS, MOMENTUM_BARS))
    out = pd.DataFrame(
        {
            "rolling_5d_volatility": log_return.rolling(VOLATILITY_BARS).std(),
            "rolling_20d_return": (close - month) / month,
            "volume_zscore": (volume - buffer.mean()) / spread.where(spread > 0),
            "price_momentum_10d": (close - fortnight) / fortnight,
        }
    )
    out[np.arange(1, len(close) + 1) < LIVE_MIN_BARS] = np.nan
    return out.iloc[old:]


class LiveFeatures(StatefulProcessor):
    """A list state of the last 50 bars of a ticker, filled from history before the first bar."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", "start long, close double, volume double")

    def close(self) -> None:
        pass

    def _read(self) -> np.ndarray:
        rows = [tuple(r) for r in self.bars.get()] if self.bars.exists() else []
        return np.array(rows, float).reshape(-1, 3), np.array([r[0] for r in rows], np.int64)

    def _write(self, start: np.ndarray, close: np.ndarray, volume: np.ndarray) -> None:
        last = slice(-LIVE_BUFFER_BARS, None)
        self.bars.put([(int(s), float(c), float(v)) for s, c, v in zip(start[last], close[last], volume[last])])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        own = initialState.sort_values("bar_start", kind="stable")
        if len(own):
            self._write(micros(own["bar_start"]), own["close"].to_numpy(float), own["volume"].to_numpy(float))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Of a backlog only three numbers a bar are held, in time order.
        chunks = [(micros(b["bar_start"]), b["close"].to_numpy(float), b["volume"].to_numpy(float)) for b in rows]
        start, close, volume = (np.concatenate(x) for x in zip(*chunks))
        kept, starts = self._read()
        order = np.argsort(start, kind="stable")
        if len(starts):
            # Bars that do not follow the state were already applied or came too late.
            order = order[start[order] > starts[-1]]
        if not len(order):
            return
        all_start = np.concatenate((starts, start[order]))
        closes = np.concatenate((kept[:, 1], close[order]))
        volumes = np.concatenate((kept[:, 2], volume[order]))
        self._write(all_start, closes, volumes)
        out = vectors_after(closes, volumes, len(starts))
        at = pd.Series(all_start[len(starts):].astype("datetime64[us]"))
        out.insert(0, "knowledge_timestamp", at.to_numpy())
        out.insert(0, "event_timestamp", at.to_numpy())
        out.insert(0, "entity_id", key[0])
        emitted = out.dropna(subset=list(FEATURE_NAMES))
        if len(emitted):
            yield emitted


def seeded_feature_stream(bars: DataFrame, history: DataFrame | None, interval: str) -> DataFrame:
    """Feature vectors of a bar stream whose tickers start with the bars of ``history``.

    ``history`` (ticker, bar_start, close, volume; the last 50 of each ticker, see ``seed_history``) is read in
    the first micro-batch only and emits nothing; a restart goes on from the checkpoint. Without it the
    stream is that of ``live.feature_stream``. A vector belongs to its bar's start and is known at its end.
    """
    columns = ("ticker", "bar_start", "close", "volume")
    initial = None if history is None else history.select(*columns).groupBy("ticker")
    vectors = bars.select(*columns).groupBy("ticker").transformWithStateInPandas(
        LiveFeatures(), VECTORS, "Append", "None", initialState=initial)
    return vectors.withColumn("knowledge_timestamp", F.col("event_timestamp") + F.expr(f"interval {interval}"))


class TickerStatus(StatefulProcessor):
    """Counters and last tick of a ticker, and the starts of its first 51 bars, whatever order ticks come in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ticks long, at long, tie long, price double, volume double")
        self.starts = handle.getMapState("starts", "start long", "seen boolean")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks, at, tie, price, volume = tuple(self.last.get()) if self.last.exists() else (0, None, None, None, None)
        known = {k[0] for k in self.starts.keys()} if self.starts.exists() else set()
        for chunk in rows:
            times, ties = micros(chunk["timestamp"]), chunk["tie"].to_numpy(np.int64)
            ticks += len(chunk)
            i = np.lexsort((ties, times))[-1]
            if at is None or (times[i], ties[i]) > (at, tie):
                at, tie = int(times[i]), int(ties[i])
                price, volume = (None if pd.isna(x) else float(x) for x in (chunk["price"].iloc[i], chunk["volume"].iloc[i]))
            # The bar of the last tick is open; beyond a full buffer more bars make no difference.
            for start in np.unique(micros(chunk["bar"])).tolist():
                if start not in known and len(known) <= LIVE_BUFFER_BARS:
                    known.add(start)
                    self.starts.updateValue((start,), (True,))
        self.last.update((ticks, at, tie, price, volume))
        bars = len(known) - 1
        yield pd.DataFrame({
            "ticker": [key[0]], "tick_count": [ticks], "last_price": [price], "last_volume": [volume],
            "last_update": [pd.Timestamp(at, unit="us")], "bars_accumulated": [bars], "features_ready": [bars >= LIVE_MIN_BARS],
        })


def status_stream(ticks: DataFrame, interval: str, tie: str) -> DataFrame:
    """``STATUS`` of every ticker that a micro-batch touched (update mode).

    ``tie`` orders ticks of one time. Ticks without a time are not counted.
    """
    timed = ticks.filter(F.col("timestamp").isNotNull()).select(
        "ticker", "timestamp", F.col(tie).cast("long").alias("tie"), "price", "volume",
        F.window("timestamp", interval)["start"].alias("bar"))
    return timed.groupBy("ticker").transformWithStateInPandas(TickerStatus(), STATUS, "Update", "None")
