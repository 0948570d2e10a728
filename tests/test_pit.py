import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitempo.operators import pit
from bitempo.operators.online import latest_values, online_asof, order_divergence
from bitempo.plans.hot import hot_entities
from bitempo.schema import FEATURE_NAMES, FEATURES

from .helpers import (
    REQUESTS, brute_asof, by_keys, features, random_facts, random_requests, requests, t,
)

DAYS = [
    ("AAPL", "f", 10.0, "2020-01-01", "2020-01-01"),
    ("AAPL", "f", 11.0, "2020-01-02", "2020-01-02"),
    ("AAPL", "f", 12.0, "2020-01-03", "2020-01-03"),
]
REVISED = [
    ("X", "f", 5.0, "2020-01-10", "2020-01-10"),
    ("X", "f", 5.5, "2020-01-10", "2020-01-13"),
]


def read(spark, rows, entity, at, **kw):
    out = pit.pit_join(requests(spark, [(entity, at)]), features(spark, rows), ["f"], **kw)
    return [r["f"] for r in out.collect()]


@pytest.mark.parametrize(
    ("at", "expect"),
    [
        ("2020-01-02 12:00", [11.0]),
        ("2020-01-03 00:00", [12.0]),
        ("2019-12-31", []),
        ("2020-01-02 23:59", [11.0]),
        ("2031-01-01", [12.0]),
    ],
)
def test_latest_knowable(spark, at, expect):
    assert read(spark, DAYS, "AAPL", at) == expect


def test_late_knowledge_is_invisible_before(spark):
    late = [("AAPL", "f", 99.0, "2020-01-05", "2020-01-08")]
    assert read(spark, late, "AAPL", "2020-01-06") == []
    assert read(spark, late, "AAPL", "2020-01-09") == [99.0]


@pytest.mark.parametrize("order", ["event", "knowledge"])
def test_first_print_then_revision(spark, order):
    assert read(spark, REVISED, "X", "2020-01-11", order=order) == [5.0]
    assert read(spark, REVISED, "X", "2020-01-13", order=order) == [5.5]


def test_orders_diverge_when_an_old_day_is_revised(spark):
    rows = [*REVISED, ("X", "f", 7.0, "2020-01-11", "2020-01-11")]
    assert read(spark, rows, "X", "2020-01-14") == [7.0]
    assert read(spark, rows, "X", "2020-01-14", order="knowledge") == [5.5]
    counts = order_divergence(
        requests(spark, [("X", "2020-01-14"), ("X", "2020-01-12")]), features(spark, rows), ["f"]
    ).first()
    assert (counts["compared"], counts["differing"]) == (2, 1)


def test_duplicate_requests_collapse_unless_kept(spark):
    spine = requests(spark, [("AAPL", "2020-01-02")] * 3)
    store = features(spark, DAYS)
    assert pit.pit_join(spine, store, ["f"]).count() == 1
    tagged = spine.withColumn("tag", F.lit(1))
    assert pit.pit_join(tagged, store, ["f"], keep=["tag"]).count() == 3


def test_fact_known_before_it_happened_fails_the_read(spark):
    bad = [("X", "f", 1.0, "2020-01-05", "2020-01-01")]
    with pytest.raises(Exception, match="precedes event"):
        read(spark, bad, "X", "2020-01-09")


@pytest.mark.parametrize("order", ["event", "knowledge"])
@pytest.mark.parametrize("rows_per_task", [None, 50, 7])
def test_equals_brute_force(spark, order, rows_per_task):
    facts, asked = random_facts(1), random_requests(2)
    store, spine = spark.createDataFrame(facts, FEATURES), spark.createDataFrame(asked, REQUESTS)
    hot = None
    if rows_per_task:
        hot = hot_entities(store, "entity_id", "event_timestamp", rows_per_task)
        assert hot.entities.count() > 0
    got = by_keys(
        pit.pit_join_long(spine, store, order=order, hot=hot),
        "entity_id", "request_time", "feature_name",
    )
    want = brute_asof(facts, asked, order)
    pd.testing.assert_frame_equal(got[list(want.columns)], want, check_dtype=False)


def test_wide_store_gives_the_same(spark):
    facts = random_facts(3)
    facts["knowledge_timestamp"] = facts["event_timestamp"]
    facts = facts.drop_duplicates(["entity_id", "feature_name", "event_timestamp"])
    wide = facts.pivot(
        index=["entity_id", "event_timestamp", "knowledge_timestamp"],
        columns="feature_name", values="value",
    ).reset_index()
    wide = wide[["entity_id", "event_timestamp", "knowledge_timestamp", *FEATURE_NAMES]]
    table = pa.Table.from_pandas(wide, preserve_index=False)  # NaN becomes NULL
    store = spark.createDataFrame(table)
    spine = spark.createDataFrame(random_requests(4), REQUESTS)
    got = by_keys(pit.pit_join(spine, store), "entity_id", "request_time")
    want = by_keys(
        pit.pit_join(spine, spark.createDataFrame(facts, FEATURES)), "entity_id", "request_time"
    )
    pd.testing.assert_frame_equal(got, want)


def test_single_read(spark):
    store = features(spark, [*DAYS, *REVISED])
    at = F.lit("2020-01-12").cast("timestamp_ntz")
    assert pit.pit_single(store, "X", at).first()["value"] == 5.0
    assert pit.pit_single(store, "nobody", at).count() == 0


def test_audit_reports_planted_leak(spark):
    joined = pit.pit_join_long(
        requests(spark, [("AAPL", "2020-01-02"), ("AAPL", "2020-01-03")]),
        features(spark, DAYS), ["f"],
    )
    pit.assert_no_leak(joined)
    planted = joined.withColumn(
        "knowledge_timestamp", F.lit("2020-01-03 00:00").cast("timestamp_ntz")
    )
    assert pit.leakage_audit(planted).first()["violations"] == 1
    assert pit.leaking_rows(planted).count() == 1
    with pytest.raises(AssertionError):
        pit.assert_no_leak(planted)


def test_online_log(spark):
    log = features(spark, REVISED)
    spine = requests(spark, [("X", "2020-01-11"), ("X", "2020-01-14")])
    got = by_keys(online_asof(spine, log, ["f"]), "request_time")["f"].tolist()
    assert got == [5.0, 5.5]
    late_first = spark.createDataFrame(log.orderBy(F.desc("knowledge_timestamp")).collect(), FEATURES)
    assert latest_values(late_first).first()["value"] == 5.5


def test_plan_has_one_shuffle_and_no_pairs(spark):
    store = spark.createDataFrame(random_facts(5), FEATURES)
    spine = spark.createDataFrame(random_requests(6), REQUESTS)
    plan = pit.pit_join(spine, store, hot=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    for word in ("CartesianProduct", "NestedLoop", "Join", "Python"):
        assert word not in plan


@pytest.mark.parametrize("order", ["event", "knowledge"])
def test_few_requests(spark, order):
    facts, asked = random_facts(41), random_requests(42, 60)
    store, spine = spark.createDataFrame(facts, FEATURES), spark.createDataFrame(asked, REQUESTS)
    keys = ["entity_id", "request_time", "feature_name"]
    got = pit.pit_join_long(spine, store, order=order, asked_only=True)
    want = brute_asof(facts, asked, order)
    pd.testing.assert_frame_equal(by_keys(got, *keys)[list(want.columns)], want, check_dtype=False)


@pytest.mark.parametrize("asked_only", [False, True])
@pytest.mark.parametrize("rows_per_task", [None, 40])
def test_nulls_agree_in_every_plan(spark, asked_only, rows_per_task):
    facts, asked = random_facts(51), random_requests(52)
    facts.loc[::7, "knowledge_timestamp"] = pd.NaT
    facts.loc[::11, "entity_id"] = None
    asked.iloc[::9, 1] = pd.NaT
    asked.iloc[::13, 0] = None
    rows = lambda df: [tuple(None if pd.isna(v) else v for v in r) for r in df.itertuples(index=False)]
    clean = lambda values: [
        tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in values
    ]
    store = spark.createDataFrame(clean(rows(facts)), FEATURES)
    spine = spark.createDataFrame(clean(rows(asked)), REQUESTS)
    hot = hot_entities(store, "entity_id", "knowledge_timestamp", rows_per_task) if rows_per_task else None
    assert (hot is not None) == (rows_per_task is not None)
    got = pit.pit_join_long(spine, store, hot=hot, asked_only=asked_only)
    want = brute_asof(facts.dropna(subset=["knowledge_timestamp", "entity_id"]), asked.dropna())
    keys = ["entity_id", "request_time", "feature_name"]
    pd.testing.assert_frame_equal(by_keys(got, *keys)[list(want.columns)], want, check_dtype=False)
    single = pit.pit_single(store, "a", F.lit("2020-06-01").cast("timestamp_ntz"))
    one = pit.pit_join_long(requests(spark, [("a", "2020-06-01")]), store, hot=hot, asked_only=asked_only)
    assert sorted(map(tuple, single.collect())) == sorted(map(tuple, one.select(*single.columns).collect()))


def test_a_fact_without_knowledge_is_never_read(spark):
    rows = [("a", "f", 1.0, "2020-01-01", "2020-01-01")]
    odd = spark.createDataFrame([("a", "f", 99.0, t("2020-06-01"), None), (None, "f", 5.0, t("2020-01-01"), t("2020-01-01"))], FEATURES)
    store = features(spark, rows).unionAll(odd)
    spine = spark.createDataFrame([("a", t("2020-02-01")), ("a", None), (None, t("2020-02-01"))], REQUESTS)
    for asked_only in (False, True):
        got = pit.pit_join(spine, store, ["f"], asked_only=asked_only).collect()
        assert [(r.entity_id, r.f) for r in got] == [("a", 1.0)]
