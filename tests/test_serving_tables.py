"""Bucketed latest table, two providers, streamed subscriptions: against the plain forms and after restarts."""

import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bitempo.catalog.queries import TICK_ROWS
from bitempo.operators.online import latest_values
from bitempo.schema import FEATURE_COLUMNS, FEATURES
from bitempo.streaming import latest_table, live, membership, providers, stateful
from bitempo.streaming import sources as src

BUCKETS = 8


def log_of(spark, rows):
    day = dt.datetime(2024, 1, 1)
    full = [(e, f, float(v), day + dt.timedelta(days=t), day + dt.timedelta(days=k)) for e, f, v, t, k in rows]
    return spark.createDataFrame(full, FEATURES)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*FEATURE_COLUMNS).collect())


@pytest.fixture
def batches(spark):
    wide = [(f"e{i}", "rolling_5d_volatility", i, 0, 0) for i in range(60)]
    late = [("e1", "rolling_5d_volatility", 7, 0, 0), ("e1", "volume_zscore", 1, 1, 1)]
    # Late, repeated and tied rows of one key.
    hot = [("e1", "volume_zscore", v, 2, 2) for v in range(200)] + [("e1", "volume_zscore", 9, 5, 1)]
    return [log_of(spark, r) for r in (wide, late, hot, [], [("e2", "volume_zscore", 3, 3, 3)])]


def test_folds_equal_the_plain_latest(spark, batches, tmp_path):
    path, seen = f"file://{tmp_path}/t", None
    write = latest_table.bucketed_sink(path, 2, BUCKETS)
    for n, batch in enumerate(batches):
        write(batch, n)
        seen = batch if seen is None else seen.unionByName(batch)
        assert rows_of(latest_table.read_latest(spark, path)) == rows_of(latest_values(seen))
        assert rows_of(latest_table.read_history(spark, path)) == rows_of(seen)


def test_only_touched_buckets_are_rewritten(spark, batches, tmp_path):
    path = f"file://{tmp_path}/t"
    write = latest_table.bucketed_sink(path, 1, BUCKETS)
    write(batches[0], 0)
    assert len(latest_table.versions_at(spark, path, 0)) == BUCKETS
    batches[4].write.parquet(f"{path}/log/batch=1")
    touched = latest_table.fold(spark, path, 1, BUCKETS)
    assert len(touched) == 1
    now = latest_table.versions_at(spark, path, 1)
    assert [b for b, v in now.items() if v == 1] == touched
    assert os.listdir(f"{tmp_path}/t/values/version=1").count(f"bucket={touched[0]}") == 1
    assert latest_table.fold(spark, path, 2, BUCKETS) == []


def test_a_fold_run_again_changes_nothing(spark, batches, tmp_path):
    path, plain = f"file://{tmp_path}/t", rows_of(latest_values(batches[0].unionByName(batches[1]).unionByName(batches[2])))
    write = latest_table.bucketed_sink(path, 1, BUCKETS)
    for n in (0, 1, 2, 2, 2):
        write(batches[n], n)
    assert rows_of(latest_table.read_latest(spark, path)) == plain
    assert latest_table.read_history(spark, path).count() == 60 + 2 + 201


def test_an_unfinished_fold_is_ignored(spark, batches, tmp_path):
    path = f"file://{tmp_path}/t"
    write = latest_table.bucketed_sink(path, 1, BUCKETS)
    write(batches[0], 0)
    batches[2].write.parquet(f"{path}/log/batch=1")
    # Values and segment are written, the list of versions is not.
    batches[4].withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/values/version=1")
    batches[4].write.parquet(f"{path}/segments/upto=1")
    both = batches[0].unionByName(batches[2])
    assert rows_of(latest_table.read_latest(spark, path)) == rows_of(latest_values(both))
    assert rows_of(latest_table.read_history(spark, path)) == rows_of(both)
    latest_table.fold(spark, path, 1, BUCKETS)
    assert rows_of(latest_table.read_latest(spark, path)) == rows_of(latest_values(both))


def test_old_versions_and_log_folders_go(spark, batches, tmp_path):
    path = f"file://{tmp_path}/t"
    write = latest_table.bucketed_sink(path, 1, BUCKETS)
    for n in range(8):
        write(batches[0].withColumn("value", F.lit(float(n))), n)
    assert latest_table.folders(spark, f"{path}/values", "version") == [5, 6, 7]
    assert latest_table.folders(spark, f"{path}/folds", "upto") == [5, 6, 7]
    assert latest_table.folders(spark, f"{path}/log", "batch") == [7]
    assert latest_table.read_history(spark, path).count() == 8 * 60


def test_empty_table_and_wrong_number_of_buckets(spark, batches, tmp_path):
    path = f"file://{tmp_path}/t"
    assert latest_table.read_latest(spark, path).isEmpty()
    latest_table.bucketed_sink(path, 1, BUCKETS)(batches[3], 0)
    assert latest_table.read_latest(spark, path).isEmpty()
    latest_table.bucketed_sink(path, 1, BUCKETS)(batches[0], 1)
    with pytest.raises(ValueError):
        latest_table.bucketed_sink(path, 1, BUCKETS + 1)(batches[0], 2)


def ticks_at(spark, rows):
    at = dt.datetime(2024, 1, 1, 9)
    return spark.createDataFrame(
        [(t, float(p), float(v), None if m is None else at + dt.timedelta(minutes=m), "x", i) for t, p, v, m, i in rows],
        TICK_ROWS)


def run_two(spark, root, lands):
    for trades, quotes in lands:
        src.land(ticks_at(spark, trades).coalesce(1), f"{root}/trades")
        src.land(ticks_at(spark, quotes).coalesce(1), f"{root}/quotes")
        bars = providers.provider_bars(
            src.table_stream(spark, f"{root}/trades", TICK_ROWS, None),
            src.table_stream(spark, f"{root}/quotes", TICK_ROWS, None), "1 hour", "10 minutes", "10 minutes", "event_id")
        live.run_available(bars, f"{root}/bars", f"{root}/ck")
    return spark.read.schema(bars.schema).parquet(f"{root}/bars")


def test_two_providers_drop_repeats_and_wait_for_the_slower_one(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    trades = [("a", 10, 1, 5, 1), ("a", 12, 2, 6, 2), ("a", 12, 2, 6, 2), ("b", 1, 1, None, 9)]
    polls = [("a", 11, 5, 20, 3), ("a", 13, 8, 20.5, 4)]
    # Trades run far ahead; quotes still come for the first hour.
    first = run_two(spark, root, [(trades, polls), ([("a", 99, 1, 400, 5), ("a", 12, 2, 6, 2)], [("a", 20, 4, 40, 6)])])
    assert first.isEmpty()
    bars = run_two(spark, root, [([("z", 0, 0, 9000, 7)], [("z", 0, 0, 9000, 8)])])
    got = {(r.ticker, r.bar_start.hour): (r.open, r.high, r.low, r.close, r.volume) for r in bars.collect()}
    assert got[("a", 9)] == (10.0, 20.0, 10.0, 20.0, 1 + 2 + 8 + 4)
    assert got[("a", 15)] == (99.0, 99.0, 99.0, 99.0, 1.0)
    assert len(got) == 2


def test_provider_bars_of_tables(spark):
    trades = ticks_at(spark, [("a", 10, 1, 5, 1), ("a", 10, 1, 5, 1)])
    bars = providers.provider_bars(trades, ticks_at(spark, [("a", 9, 2, 5, 2)]), "1 hour", "1 hour", "1 hour", "event_id")
    assert [(r.open, r.close, r.volume) for r in bars.collect()] == [(10.0, 9.0, 3.0)]
    none = trades.limit(0)
    assert providers.provider_bars(none, none, "1 hour", "1 hour", "1 hour", "event_id").isEmpty()


def test_subscriptions_as_a_stream_wait_for_changes(spark, tmp_path):
    root = f"file://{tmp_path}/m"
    stateful.use_rocksdb(spark)
    at = dt.datetime(2024, 1, 1, 9)
    change = "ticker string, at timestamp, seq long, added boolean"

    def step(ticks, changes):
        src.land(ticks_at(spark, ticks).coalesce(1), f"{root}/ticks")
        turned = [(t, at + dt.timedelta(minutes=m), s, a) for t, m, s, a in changes]
        src.land(spark.createDataFrame(turned, change).coalesce(1), f"{root}/changes")
        kept = membership.subscribed_stream(
            src.table_stream(spark, f"{root}/ticks", TICK_ROWS, None),
            src.table_stream(spark, f"{root}/changes", spark.createDataFrame([], change).schema, None),
            "30 minutes", "30 minutes")
        live.run_available(kept, f"{root}/kept", f"{root}/ck")
        rows = spark.read.schema(kept.schema).parquet(f"{root}/kept")
        return sorted((r.ticker, r.event_id) for r in rows.collect())

    # The tick at minute 10 is there before the change at minute 10 that subscribes its symbol.
    assert step([("A", 1, 1, 10, 1), ("A", 1, 1, 5, 2), (None, 1, 1, 10, 3)], [("B", 0, 1, True)]) == []
    step([("B", 1, 1, 12, 4), ("A", 1, 1, 20, 5)], [(" a ", 10, 1, False), ("a", 10, 2, True), ("A", 15, 3, False)])
    assert step([("Z", 1, 1, 900, 9)], [("Z", 900, 9, False)]) == [("A", 1), ("B", 4)]
