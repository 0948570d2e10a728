"""Stored feature tables, subscriptions over time, business days, the area under the ROC curve."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bitempo.functions.business import BusinessCalendar
from bitempo.operators.pit import pit_join
from bitempo.operators.subscriptions import subscribed_over_time
from bitempo.plans.hot import hot_entities
from bitempo.plans.ordered import rank_area
from bitempo.sources import feature_store

FEATURES = ("a", "b")
STORE = "entity_id string, feature_name string, value double, event_timestamp timestamp_ntz, knowledge_timestamp timestamp_ntz"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def facts(spark, n, seed, names="ABCDEFGH"):
    """A third of the facts are A's."""
    rng = np.random.default_rng(seed)
    share = [1 / 3] + [2 / 3 / (len(names) - 1)] * (len(names) - 1)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        event = start + dt.timedelta(minutes=int(rng.integers(0, 5000)))
        rows.append((str(rng.choice(list(names), p=share)), str(rng.choice(list(FEATURES))), float(i), event,
                     event + dt.timedelta(minutes=int(rng.integers(0, 500)))))
    return spark.createDataFrame(rows, STORE)


def asked(spark, n, seed, names="ABCDEFGHZ"):
    rng = np.random.default_rng(seed)
    rows = [(str(rng.choice(list(names))), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(rng.integers(0, 6000)))) for _ in range(n)]
    return spark.createDataFrame([*rows, *rows[:5], (None, rows[0][1]), ("A", None)], "entity_id string, request_time timestamp_ntz")


def exchanges_above_scan(plan: str) -> int:
    """Exchanges on the way from the root of a formatted plan to its bucketed scan."""
    lines = plan.split("\n\n")[0].splitlines()
    scan = next(i for i, line in enumerate(lines) if "Scan parquet" in line)
    depth, above = len(lines[scan]) - len(lines[scan].lstrip(" :+-")), 0
    for line in reversed(lines[:scan]):
        own = len(line) - len(line.lstrip(" :+-"))
        if own < depth:
            depth, above = own, above + ("Exchange" in line)
    return above


def formatted(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("order", ["event", "knowledge"])
@pytest.mark.parametrize("rows_per_task", [10_000, 60, 5])
def test_stored_join_equals_the_plain_one(spark, tmp_path, order, rows_per_task):
    table = f"store_{order}_{rows_per_task}"
    long, spine = facts(spark, 400, 1), asked(spark, 200, 2)
    nothing = spark.createDataFrame([(None, "a", 1.0, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1)),
                                     ("B", "a", 1.0, dt.datetime(2024, 1, 1), None)], STORE)
    store = feature_store.write_store(long.unionByName(nothing), str(tmp_path), table, 6, rows_per_task)
    assert (store.large is not None) == (rows_per_task < 10_000)
    want = rows_of(pit_join(spine, long, FEATURES, order, hot=None))
    got = feature_store.stored_join(spine, store, order, features=FEATURES)
    assert rows_of(got) == want and len(want) > 100
    if rows_per_task == 10_000:
        assert exchanges_above_scan(formatted(got)) == 0
        assert exchanges_above_scan(formatted(pit_join(spine, store.ordinary, FEATURES, order, hot=None))) == 1
    # Another session finds the table by its files.
    spark.sql(f"DROP TABLE {table}")
    again = feature_store.open_store(spark, str(tmp_path), table, 6, STORE, store.large is not None, rows_per_task)
    assert rows_of(feature_store.stored_join(spine, again, order, features=FEATURES)) == want
    assert rows_of(feature_store.stored_join(spine.limit(0), again, order, features=FEATURES)) == []


def test_wide_store_without_rows(spark, tmp_path):
    wide = spark.createDataFrame([], "entity_id string, event_timestamp timestamp_ntz, knowledge_timestamp timestamp_ntz, a double, b double")
    store = feature_store.write_store(wide, str(tmp_path), "store_empty", 3)
    assert feature_store.stored_join(asked(spark, 9, 3), store, features=FEATURES).count() == 0


# --- subscriptions ------------------------------------------------------------------------------


def test_subscriptions_over_time(spark):
    rng = np.random.default_rng(5)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(rng.integers(0, 300)))
    ticks = [(str(rng.choice(["A", "A", "B", "C"])), at(), float(i)) for i in range(500)]
    ticks += ticks[:20]
    changes = [(str(rng.choice(["a", " A ", "b"])), at(), i, bool(rng.random() < 0.5)) for i in range(120)]
    odd_ticks = [(None, ticks[0][1], 0.0), ("A", None, 0.0)]
    odd = [("  ", changes[0][1], 1, True), (None, changes[0][1], 1, True), ("C", None, 1, True), ("C", changes[0][1], 1, None)]
    tick_rows = spark.createDataFrame(ticks + odd_ticks, "ticker string, timestamp timestamp_ntz, at double")
    change_rows = spark.createDataFrame(changes + odd, "ticker string, at timestamp_ntz, seq int, added boolean")

    want = []
    for tick in ticks:
        own = [(c[1], c[2], c[3]) for c in changes if c[0].strip().upper() == tick[0] and c[1] <= tick[1]]
        if own and max(own)[2]:
            want.append(tick)
    assert 50 < len(want) < 400
    for hot in (None, "auto", hot_entities(tick_rows, "ticker", "timestamp", 9)):
        assert rows_of(subscribed_over_time(tick_rows, change_rows, hot=hot)) == sorted(want, key=repr)
    bare = subscribed_over_time(tick_rows.drop("at"), change_rows)
    assert rows_of(bare) == sorted((t[:2] for t in want), key=repr)
    assert subscribed_over_time(tick_rows, change_rows.limit(0)).count() == 0


# --- business days ------------------------------------------------------------------------------


@pytest.mark.parametrize("n_holidays", [None, 0, 1, 2, 60])
def test_business_days(spark, n_holidays):
    rng = np.random.default_rng(n_holidays or 0)
    first = np.datetime64("1967-12-20")
    closed = [] if not n_holidays else sorted(set(first + rng.integers(0, 900, n_holidays)))
    pairs = [(first + int(rng.integers(0, 900)), first + int(rng.integers(0, 900)), int(rng.integers(-40, 40))) for _ in range(300)]
    holidays = None
    if n_holidays is not None:
        listed = [(d.astype(dt.date),) for d in [*closed, *closed[:3]]] + [(None,)]
        holidays = spark.createDataFrame(listed, "holiday date")
    calendar = BusinessCalendar(holidays)
    df = spark.createDataFrame([(a.astype(dt.date), b.astype(dt.date), n) for a, b, n in pairs] + [(None, None, 1)], "a date, b date, n int")
    got = df.select("a", "b", "n", calendar.gap(F.col("a"), F.col("b")).alias("gap"), calendar.add(F.col("a"), F.col("n")).alias("to")).collect()
    for a, b, n, gap, to in got:
        if a is None:
            assert gap is None and to is None
            continue
        low, high = min(a, b), max(a, b)
        between = int(np.busday_count(low, high, holidays=closed))
        assert gap == (between if a <= b else -between)
        # Back from a closed day: the open day before it is one away.
        day = np.datetime64(a)
        assert np.datetime64(to) == np.busday_offset(day, n, roll="forward", holidays=closed)


# --- area ---------------------------------------------------------------------------------------


def test_area_with_one_score_on_half_the_rows(spark):
    rng = np.random.default_rng(7)
    n = 4000
    frame = pd.DataFrame({"s": np.where(rng.random(n) < 0.5, 0.5, rng.random(n)), "y": rng.integers(0, 2, n)})
    frame.loc[:9, "s"] = -0.0
    frame.loc[10:19, "s"] = 0.0
    ranks, n1 = frame["s"].rank(), int(frame["y"].sum())
    want = (ranks[frame["y"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (n - n1))
    df = spark.createDataFrame(frame)
    odd = spark.createDataFrame([(None, 1), (0.1, None), (0.2, 7)], "s double, y bigint")
    row = rank_area(df.unionByName(odd).repartition(16), "s", "y").first()
    assert row["n"] == n and row["area"] == pytest.approx(want, rel=1e-12)
    # NaN is the greatest score.
    top = spark.createDataFrame([(float("nan"), 1), (9.0, 0)], "s double, y bigint")
    assert rank_area(top, "s", "y").first()["area"] == 1.0
    assert tuple(rank_area(df.filter("y = 1"), "s", "y").first()) == (n1, None)
    assert tuple(rank_area(df.limit(0), "s", "y").first()) == (0, None)
