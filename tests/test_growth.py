"""What a task takes and what moves must not grow with the tables."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitempo.catalog import queries
from bitempo.operators import backtest as bt
from bitempo.operators.features import live_features
from bitempo.plans.asof import own_states
from bitempo.plans.hot import _chunk_map, hot_entities
from bitempo.session import small_splits

from .test_moves import lines  # noqa: F401

SPLIT = "spark.sql.files.maxPartitionBytes"


def day(n: int) -> dt.datetime:
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def test_tasks_of_the_chunk_map_follow_its_buckets(spark, lines, monkeypatch):  # noqa: F811
    bars = queries.Inputs(spark, lines).bars.cache()
    monkeypatch.setattr("bitempo.session.MAX_TASK_ROWS", 20)
    hot = hot_entities(bars, "ticker", "date", 20)
    buckets = _chunk_map(bars, "ticker", "date", hot, 2, 1, None)
    held = bars.filter("ticker is not null").count()
    assert held * 0.5 < hot.spots <= held
    plan = buckets._jdf.queryExecution().executedPlan().toString()
    assert f"{-(-hot.spots // 20)}), REPARTITION_BY_NUM" in plan
    bars.unpersist()


def test_own_requests_stay_one_row_and_see_their_instant(spark):
    rows = [("a", day(1), day(1), 1.0, 1), ("a", day(0), day(2), 9.0, 2), ("a", day(2), day(2), 2.0, 3),
            ("a", day(3), day(3), None, 4), ("a", day(2), day(5), 7.0, 5), ("b", day(1), day(1), None, 6)]
    table = spark.createDataFrame(
        rows, "entity_id string, event_timestamp timestamp_ntz, knowledge_timestamp timestamp_ntz, f double, k int")
    got = {r["k"]: r["f"]["value"] if r["f"] else None for r in own_states(table, ["f"], keep=["k"], hot=None).collect()}
    assert got == {1: 1.0, 2: None, 3: 2.0, 4: 2.0, 5: 2.0, 6: None}
    plain = own_states(table, ["f"], hot=None)
    assert sorted((r[0], r[1].day) for r in plain.collect()) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 2)]
    once = table.filter(F.col("event_timestamp") == F.col("knowledge_timestamp"))
    own = own_states(once, ["f"], keep=["k"], hot=None)
    # Facts and requests of one time are not doubled: the window takes in as many rows as the table has.
    taken = own._jdf.queryExecution().optimizedPlan().toString()
    assert own.count() == once.count() == 4 and "RangeFrame" in taken


def test_evaluation_stores_only_what_it_reads(spark, monkeypatch):
    wrote = {}
    monkeypatch.setattr(bt, "stage", lambda df, name: (wrote.setdefault(name, df.columns), df)[1])
    rows = [(f"t{i % 3}", day(i // 3), 10.0 + (i * 7) % 5, 10.0 + (i * 7) % 5, 100 + (i * 13) % 17, False) for i in range(240)]
    bars = spark.createDataFrame(
        rows, "ticker string, date timestamp_ntz, close double, first_print_close double, volume long, revised boolean")
    result = bt.backtest(bars, hot=None, fit=lambda _: queries.FIXED).collect()
    assert {r.variant for r in result} == {"correct", "leaked"}
    assert wrote["scored-correct"] == wrote["scored-leaked"] == ["entity_id", "request_time", "label", "ret", "p_up"]


def test_reports_and_scores_write_no_features(spark, lines, monkeypatch):  # noqa: F811
    monkeypatch.setattr("bitempo.session.MIN_TASK_ROWS", 50)
    suppliers = spark.range(7).selectExpr("id AS s_suppkey", "'s' AS s_name", "1 AS s_nationkey", "0.0D AS s_acctbal")
    suppliers.write.mode("overwrite").parquet(f"{lines}/supplier.parquet")
    names = []
    real = queries.stage
    monkeypatch.setattr(queries, "stage", lambda df, name: (names.append(name), real(df, name))[1])
    x = queries.Inputs(spark, lines)
    checks = queries.report(x).count()
    assert checks > 0 and "features" not in names
    queries.score_leaked(queries.Inputs(spark, lines)).collect()
    assert "features" not in names and "matrix" in names


def test_logs_are_scanned_in_small_splits(spark, tmp_path):
    before = spark.conf.get(SPLIT)
    try:
        spark.conf.set(SPLIT, "128m")
        small_splits(spark)
        assert int(spark.conf.get(SPLIT)) == 16 << 20
        spark.conf.set(SPLIT, "1m")
        small_splits(spark)
        assert spark.conf.get(SPLIT) == "1m"
    finally:
        spark.conf.set(SPLIT, before)


def test_live_zscore_is_that_of_the_whole_buffer(spark):
    rng = np.random.default_rng(5)
    bars = []
    for ticker, volumes in {
        "a": rng.integers(1, 1000, 130).astype(float), "flat": np.full(80, 0.1), "late": np.r_[np.full(60, 0.3), rng.random(30)],
        "gaps": np.where(rng.random(90) < 0.3, np.nan, rng.random(90)), "huge": 1e5 + rng.random(70),
    }.items():
        bars += [(ticker, day(i), 5.0 + (i * 3) % 7, None if math.isnan(v) else float(v)) for i, v in enumerate(volumes)]
    frame = spark.createDataFrame(bars, "ticker string, date timestamp_ntz, close double, volume double")
    for hot in (None, hot_entities(frame, "ticker", "date", 60)):
        got = {(r.entity_id, r.event_timestamp): r.volume_zscore for r in live_features(frame, hot=hot).collect()}
        want = {}
        for ticker in {b[0] for b in bars}:
            own = [b for b in bars if b[0] == ticker]
            for i in range(20, len(own)):
                told = [b[3] for b in own[max(0, i - 49): i + 1] if b[3] is not None]
                if own[i][3] is not None and len(told) > 1 and len(set(told)) > 1:
                    want[ticker, own[i][1]] = (own[i][3] - np.mean(told)) / np.std(told, ddof=1)
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-6) for k in want)
        assert not any(t == "flat" for t, _ in got)
