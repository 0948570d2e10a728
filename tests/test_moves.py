"""How often rows move, and into how many tasks."""

from __future__ import annotations

import datetime as dt

import pytest

from bitempo.operators import online, pit, reconcile
from bitempo.operators.features import to_long, to_wide, wide_features
from bitempo.plans.asof import facts_in_orders
from bitempo.plans.hot import hot_entities, split_rows
from bitempo.schema import FEATURE_NAMES, FEATURES
from bitempo.session import MAX_TASK_ROWS, tasks_for
from bitempo.sources import feature_store
from bitempo.sources.tables import line_bars

from .helpers import REQUESTS, features, random_facts, random_requests, requests

LINES = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz"
)


def moves(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    start, root = dt.datetime(2000, 1, 1), str(tmp_path_factory.mktemp("lines"))
    rows = [
        (i, i, i % 7 or None, 1, 2.0 + i % 3, 10.0 + i, 0.0, 0.0, "N", "O", start + dt.timedelta(days=i // 9))
        for i in range(600)
    ]
    spark.createDataFrame(rows, LINES).write.parquet(f"{root}/lineitem.parquet")
    return root


def test_bars_features_and_latest_values_share_one_move(spark, lines, monkeypatch):
    monkeypatch.setattr("bitempo.session.MIN_TASK_ROWS", 50)
    wide = wide_features(line_bars(spark, lines), "correct", None)
    assert moves(wide) == 1
    assert moves(online.latest_values(to_long(wide))) == 1
    assert wide.count() == line_bars(spark, lines).count() > 300


def test_bars_of_large_suppliers_are_combined_before_they_move(spark, lines):
    hot = hot_entities(line_bars(spark, lines), "ticker", "date", 20)
    plain = sorted(map(str, line_bars(spark, lines).collect()))
    assert sorted(map(str, line_bars(spark, lines, hot).collect())) == plain


def test_tasks_follow_rows(spark):
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark, 0) == tasks_for(spark, 5) == 1
    assert tasks_for(spark, usual * MAX_TASK_ROWS) == usual
    assert tasks_for(spark, 100 * MAX_TASK_ROWS + 1) == 101


def test_split_rows_take_the_tasks_of_their_number(spark, lines, monkeypatch):
    monkeypatch.setattr("bitempo.session.MAX_TASK_ROWS", 50)
    bars = line_bars(spark, lines)
    hot = hot_entities(bars, "ticker", "date", 20)
    pieces = split_rows(bars, "ticker", "date", hot, before=2)
    assert hot.tasks == pieces.rdd.getNumPartitions() == -(-bars.count() // 50)


def test_to_wide_moves_once(spark):
    long = features(spark, [
        ("a", FEATURE_NAMES[0], 1.0, "2020-01-01", "2020-01-01"), ("a", FEATURE_NAMES[2], 2.0, "2020-01-01", "2020-01-01"),
        (None, FEATURE_NAMES[1], 3.0, "2020-01-02", "2020-01-02"), ("a", "other", 4.0, "2020-01-03", "2020-01-03"),
    ])
    wide = to_wide(long, ["entity_id", "event_timestamp"])
    assert moves(wide) == 1
    got = {(r[0], r[1].day): tuple(r[2:]) for r in wide.collect()}
    assert got == {("a", 1): (1.0, None, 2.0, None), (None, 2): (None, 3.0, None, None), ("a", 3): (None,) * 4}


def test_gathered_facts_read_the_same(spark):
    facts = random_facts(11)
    again = facts.head(300).assign(value=facts["value"].head(300) + 1.0)
    store = spark.createDataFrame(facts, FEATURES).unionByName(spark.createDataFrame(again, FEATURES))
    newer_null = features(spark, [("hot", FEATURE_NAMES[0], None, "2021-01-01", "2021-01-01")])
    store = store.unionByName(newer_null)
    spine = spark.createDataFrame(random_requests(12), REQUESTS).unionByName(requests(spark, [("hot", "2022-01-01")]))
    for order in ("event", "knowledge"):
        plain = pit.pit_join(spine, store, order=order, hot=None)
        gathered = pit.pit_join(spine, store, order=order, hot=None, gather=True)
        assert sorted(map(str, gathered.collect())) == sorted(map(str, plain.collect()))
    rows = facts_in_orders(store, FEATURE_NAMES, {"": "event"}, gather=True).count()
    assert rows == store.select("entity_id", "event_timestamp", "knowledge_timestamp").distinct().count()


def test_gathering_keeps_the_alarm(spark):
    early = features(spark, [("a", FEATURE_NAMES[0], 1.0, "2020-01-05", "2020-01-01")])
    with pytest.raises(Exception, match="precedes event"):
        pit.pit_join(requests(spark, [("a", "2020-02-01")]), early, hot=None, gather=True).collect()


def test_log_that_is_the_store_passes_once(spark):
    store = spark.createDataFrame(random_facts(13), FEATURES)
    leaked = spark.createDataFrame(random_facts(14), FEATURES)
    spine = spark.createDataFrame(random_requests(15), REQUESTS)
    once = reconcile.reconcile(spine, store, leaked, store, hot=None)
    twice = reconcile.reconcile(spine, store, leaked, store.select("*"), hot=None)
    assert once._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") < (
        twice._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD"))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_store_evaluates_its_features_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    rows = random_facts(16, 400)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    table = spark.createDataFrame(rows, FEATURES).mapInArrow(count, FEATURES)
    feature_store.write_store(table, str(tmp_path), "moves_store", 2, 100)
    assert seen.value == len(rows)
