"""Subscriptions that change over time, as a stream: ticks of symbols that were subscribed when they arrived.

Ticks and changes are two streams with a watermark each. Per symbol, rows wait until the watermark has passed them;
by then every change up to their time is there, so a tick is judged as the batch form judges it
(``operators/subscriptions.py``), whatever order the two streams come in. State per symbol is its rows within
the delay and one flag.

Rows later than the watermark are dropped by Spark; put ``late.start_late_split`` before to keep them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.subscriptions import cleaned_changes

TICKS_OUT = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("event_id", T.LongType()),
    ]
)
# Waiting rows: changes come before ticks of their instant.
_WAITING = "at long, is_tick boolean, seq long, added boolean, price double, volume double"
_FIELDS = ("at", "is_tick", "seq", "added", "price", "volume")


class Membership(StatefulProcessor):
    """Keeps the rows of a symbol that the watermark has not passed, and whether it is subscribed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.subscribed = handle.getValueState("subscribed", "added boolean")

    def close(self) -> None:
        pass

    def _settle(self, symbol: str, rows: list[tuple], mark_ms: int) -> Iterator[pd.DataFrame]:
        rows.sort(key=lambda r: r[:4])
        due = sum(r[0] < mark_ms * 1000 for r in rows)
        member = bool(self.subscribed.get()[0]) if self.subscribed.exists() else False
        kept = []
        for at, is_tick, seq, added, price, volume in rows[:due]:
            if not is_tick:
                member = added
            elif member:
                kept.append((symbol, price, volume, at, seq))
        if due:
            self.subscribed.update((member,))
        if rows[due:]:
            self.waiting.put(rows[due:])
            self.handle.registerTimer(rows[due][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if kept:
            out = pd.DataFrame(kept, columns=TICKS_OUT.fieldNames())
            out["timestamp"] = out["timestamp"].to_numpy(np.int64).astype("datetime64[us]")
            yield out

    def _waiting(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._waiting()
        for chunk in rows:
            at = chunk["timestamp"].to_numpy().astype("datetime64[us]").astype(np.int64)
            columns = [at.tolist(), *(chunk[c].tolist() for c in _FIELDS[1:])]
            held += [(a, bool(t), int(s), bool(d), float(p), float(v)) for a, t, s, d, p, v in zip(*columns)]
        yield from self._settle(key[0], held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key[0], self._waiting(), timerValues.getCurrentWatermarkInMs())


def subscribed_stream(ticks: DataFrame, changes: DataFrame, tick_delay: str, change_delay: str) -> DataFrame:
    """``TICKS_OUT`` rows of subscribed ticks; ``changes`` has ticker, at, seq, added.

    Ticks without symbol or time are not subscribed. Absent prices and volumes stay absent. Needs RocksDB.
    """
    real = ticks.filter(F.col("ticker").isNotNull() & F.col("timestamp").isNotNull())
    as_rows = real.withWatermark("timestamp", tick_delay).select(
        "ticker", "timestamp", F.lit(True).alias("is_tick"), F.col("event_id").cast("long").alias("seq"),
        F.lit(False).alias("added"), F.coalesce("price", F.lit(float("nan"))).alias("price"),
        F.coalesce("volume", F.lit(float("nan"))).alias("volume"))
    turns = cleaned_changes(changes).withColumn("timestamp", F.col("at").cast("timestamp"))
    as_turns = turns.withWatermark("timestamp", change_delay).select(
        "ticker", "timestamp", F.lit(False).alias("is_tick"), "seq", "added",
        F.lit(float("nan")).alias("price"), F.lit(float("nan")).alias("volume"))
    out = as_rows.unionByName(as_turns).groupBy("ticker").transformWithStateInPandas(
        Membership(), TICKS_OUT, "Append", "EventTime")
    real_value = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("ticker", real_value("price"), real_value("volume"), "timestamp", "event_id")
