import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bitempo.catalog.queries import TICK_ROWS
from bitempo.operators.bars import build_bars, closed_bars
from bitempo.operators.features import live_features, seed_history
from bitempo.operators.online import latest_values
from bitempo.schema import FEATURE_NAMES, FEATURES, LIVE_BARS
from bitempo.streaming import live, sinks
from bitempo.streaming import sources as src

from .helpers import bars_frame, by_keys, random_bars, random_facts

ORDER = ("timestamp", "event_id")


def ticks_frame(spark, n=600):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame(
        {
            "ticker": rng.choice(["A", "B"], n), "price": rng.random(n) + 10,
            "volume": rng.integers(1, 9, n).astype(float),
            "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 172800, n)), "s"),
            "source": "test", "event_id": np.arange(n),
        }
    )
    return spark.createDataFrame(frame, TICK_ROWS)


def test_bars_equal_batch_minus_open_windows(spark, tmp_path):
    ticks = ticks_frame(spark)
    root = str(tmp_path)
    for part in src.time_slices(ticks, "timestamp", 3):
        src.land(part, f"{root}/ticks")
        stream = src.table_stream(spark, f"{root}/ticks", TICK_ROWS)
        live.run_available(
            live.bar_stream(stream, "1 hour", "30 minutes", ORDER), f"{root}/bars", f"{root}/ck"
        )
    got = by_keys(spark.read.schema(LIVE_BARS).parquet(f"{root}/bars").drop("seed"), "ticker", "bar_start")
    mark = F.lit(ticks.agg(F.max("timestamp")).first()[0]) - F.expr("interval 30 minutes")
    want = by_keys(closed_bars(build_bars(ticks, "1 hour", ORDER), "1 hour", mark), "ticker", "bar_start")
    pd.testing.assert_frame_equal(got, want)


def live_rows(bars: pd.DataFrame, spark):
    at = F.col("date").cast("timestamp")
    return bars_frame(spark, bars).select(
        "ticker", at.alias("bar_start"), "open", "high", "low", "close",
        F.col("volume").cast("double").alias("volume"), at.alias("timestamp"),
        F.lit(False).alias("seed"),
    )


def run_features(spark, root):
    stream = src.table_stream(spark, f"{root}/bars", LIVE_BARS)
    live.run_available(live.feature_stream(stream, "1 day"), f"{root}/features", f"{root}/ck")
    got = spark.read.schema(live.VECTORS).parquet(f"{root}/features")
    return by_keys(got, "entity_id", "event_timestamp")


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_features_equal_batch_across_batches_and_restarts(spark, tmp_path):
    bars, root = random_bars(21, {"A": 130, "B": 40, "C": 20}), str(tmp_path)
    rows = live_rows(bars, spark)
    for part in src.time_slices(rows, "bar_start", 3):
        src.land(part, f"{root}/bars")
        got = run_features(spark, root)
    want = by_keys(live_features(bars_frame(spark, bars), hot=None), "entity_id", "event_timestamp")
    assert got["entity_id"].tolist() == want["entity_id"].tolist()
    for f in FEATURE_NAMES:
        np.testing.assert_allclose(got[f], want[f], rtol=1e-8, atol=1e-10)

    # Nothing new, an already applied bar and a late bar all add nothing.
    assert len(run_features(spark, root)) == len(got)
    src.land(rows.filter("ticker = 'A'").orderBy("bar_start").limit(30), f"{root}/bars")
    assert len(run_features(spark, root)) == len(got)


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_seeded_buffers_emit_from_the_first_live_bar(spark, tmp_path):
    bars, root = random_bars(22, {"A": 80}), str(tmp_path)
    past, new = bars.iloc[:70], bars.iloc[70:]
    src.land(live.seed_bars(seed_history(bars_frame(spark, past), "close")), f"{root}/bars")
    assert run_features(spark, root).empty
    src.land(live_rows(new, spark), f"{root}/bars")
    got = run_features(spark, root)
    want = by_keys(live_features(bars_frame(spark, bars), hot=None), "event_timestamp").tail(10)
    assert len(got) == 10
    for f in FEATURE_NAMES:
        np.testing.assert_allclose(got[f], want[f], rtol=1e-8, atol=1e-10)


def test_log_and_latest(spark, tmp_path):
    facts, root = random_facts(31, 500), str(tmp_path)
    log = spark.createDataFrame(facts, FEATURES)
    for part in src.time_slices(log, "knowledge_timestamp", 5):
        src.land(part, f"{root}/landed")
        stream = src.table_stream(spark, f"{root}/landed", FEATURES)
        sinks.start_log(stream, f"{root}/online", f"{root}/ck", 2).awaitTermination()
    keys = ["entity_id", "feature_name"]
    want = by_keys(latest_values(log), *keys)
    pd.testing.assert_frame_equal(by_keys(sinks.read_latest(spark, f"{root}/online"), *keys), want)
    assert sinks.read_log(spark, f"{root}/online").count() == len(facts)

    # A batch that is run again replaces its own rows only.
    stored = sinks.read_log(spark, f"{root}/online")
    again = spark.createDataFrame(stored.filter("batch = 3").drop("batch").toPandas(), FEATURES)
    sinks.log_sink(f"{root}/online", 2)(again, 3)
    assert sinks.read_log(spark, f"{root}/online").count() == len(facts)
    pd.testing.assert_frame_equal(by_keys(sinks.read_latest(spark, f"{root}/online"), *keys), want)

    # Old news arriving last leaves the latest values alone.
    old = spark.createDataFrame(facts.sort_values("knowledge_timestamp").head(50), FEATURES)
    sinks.log_sink(f"{root}/online", 2)(old, 99)
    pd.testing.assert_frame_equal(by_keys(sinks.read_latest(spark, f"{root}/online"), *keys), want)


def test_counters_and_trades(spark, tmp_path):
    ticks, root = ticks_frame(spark), str(tmp_path)
    for part in src.time_slices(ticks, "timestamp", 2):
        src.land(part, f"{root}/ticks")
        stream = src.table_stream(spark, f"{root}/ticks", TICK_ROWS)
        sinks.start_counters(
            sinks.tick_counters(stream, ORDER), f"{root}/status", f"{root}/ck"
        ).awaitTermination()
    got = by_keys(sinks.read_counters(spark, f"{root}/status"), "ticker")
    frame = ticks.toPandas().sort_values(list(ORDER))
    assert got["tick_count"].tolist() == frame.groupby("ticker").size().tolist()
    assert got["last_price"].tolist() == frame.groupby("ticker")["price"].last().tolist()

    lines = [json.dumps({"type": "trade", "data": [{"s": "A", "p": i, "v": 1, "t": i}]}) for i in range(5)]
    (tmp_path / "messages").mkdir()
    (tmp_path / "messages" / "one.txt").write_text("\n".join(lines))
    live.run_available(src.trade_stream(spark, f"{root}/messages"), f"{root}/out", f"{root}/ck2")
    assert spark.read.parquet(f"{root}/out").count() == 5
