import json

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bitempo.functions.scalar import order_key, values_match
from bitempo.operators import bars as ops
from bitempo.operators import validate
from bitempo.schema import FEATURE_COLUMNS
from bitempo.sources import raw_bars as files
from bitempo.sources import ticks as tk

from .helpers import bars_frame, by_keys, features, random_bars, t

TICKS = "ticker string, price double, volume double, timestamp timestamp_ntz, event_id long"


def test_validate(spark):
    good = features(spark, [("A", "f", 1.0, "2020-01-01", "2020-01-01")])
    shuffled = good.select(*reversed(FEATURE_COLUMNS), F.lit(1).alias("extra"))
    assert validate.validate_features(shuffled).columns == list(FEATURE_COLUMNS)
    bad = features(spark, [("A", "f", 1.0, "2020-01-05", "2020-01-01")] * 2)
    with pytest.raises(ValueError, match="2 rows"):
        validate.validate_features(bad)
    with pytest.raises(ValueError, match="value"):
        validate.conform(good.drop("value"))
    with pytest.raises(PySparkException, match="precedes event"):
        validate.enforce_rows(bad).collect()
    assert validate.enforce_rows(good).first()["value"] == 1.0
    counts = validate.bitemporal_violations(good.unionByName(bad)).first()
    assert (counts["checked"], counts["violations"]) == (3, 2)


def test_conform_reads_dates_strings_and_nan(spark):
    raw = spark.createDataFrame(
        [("A", "f", float("nan"), "2020-01-01", "2020-01-02 03:04:05")], list(FEATURE_COLUMNS)
    )
    row = validate.conform(raw.withColumn("event_timestamp", F.to_date("event_timestamp"))).first()
    assert row["value"] is None
    assert row["event_timestamp"] == t("2020-01-01")
    assert row["knowledge_timestamp"] == t("2020-01-02 03:04:05")


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        (None, None, True), (None, 1.0, False), (1.0, None, False), (1.0, 1.0, True),
        (1.0, 1.0 + 1e-9, True), (1.0, 1.0 + 1e-8, False), (1e6, 1e6 + 1e-4, True),
    ],
)
def test_values_match(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    assert df.select(values_match(F.col("a"), F.col("b"))).first()[0] is same


def test_order_key_sorts_like_the_tuple(spark):
    rows = [
        (t("2020-01-01 00:00:00.000001"), 5), (t("2020-01-01"), 9), (t("2020-01-01"), -9),
        (t("1950-06-01"), 2**63 - 1), (t("9999-12-31 23:59:59.999999"), -(2**63)),
    ]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, id long")
    got = df.orderBy(order_key(df, ("ts", "id"))).collect()
    assert [tuple(r) for r in got] == sorted(rows)


def test_bars(spark):
    rows = [
        ("A", 3.0, 1.0, t("2020-01-01 00:59:59"), 1),
        ("A", 1.0, 2.0, t("2020-01-01 00:10:00"), 3),
        ("A", 2.0, 4.0, t("2020-01-01 00:10:00"), 2),
        ("A", 9.0, 8.0, t("2020-01-01 01:00:00"), 4),
    ]
    ticks = spark.createDataFrame(rows, TICKS)
    got = by_keys(ops.build_bars(ticks, "1 hour", ("timestamp", "event_id")), "bar_start")
    assert got.iloc[0][["open", "high", "low", "close", "volume"]].tolist() == [2, 3, 1, 3, 7]
    assert got.iloc[0]["timestamp"] == t("2020-01-01 00:59:59")
    assert got.iloc[1][["open", "close", "volume"]].tolist() == [9, 9, 8]
    closed = ops.closed_bars(
        ops.build_bars(ticks, "1 hour"), "1 hour", F.lit("2020-01-01 01:30").cast("timestamp_ntz")
    )
    assert closed.count() == 1
    aggregate = ops.build_bars(ticks, "1 hour", ("timestamp", "event_id"))
    assert "SortAggregate" not in aggregate._jdf.queryExecution().executedPlan().toString()


def test_polled_quotes_count_a_minute_once(spark):
    rows = [("A", 1.0, 100.0, t(f"2020-01-01 00:00:{s:02d}"), s) for s in (0, 15, 30, 45)]
    quotes = spark.createDataFrame(rows, TICKS)
    order = ("timestamp", "event_id")
    once = tk.one_quote_per_minute(quotes, order)
    assert ops.build_bars(once, "1 hour").first()["volume"] == 100.0
    assert tk.latest_quote_per_ticker(quotes, order).first()["timestamp"] == t("2020-01-01 00:00:45")


def test_trades(spark):
    texts = [
        {"type": "ping"},
        {"type": "trade", "data": [{"s": "A", "p": 1, "v": 2, "t": 1577836800123}]},
        {"type": "trade", "data": []},
        {"type": "trade", "data": [{"s": s, "p": 1.5, "v": 2.5, "t": 0} for s in "BC"]},
    ]
    messages = spark.createDataFrame([(json.dumps(x),) for x in texts] + [("broken",)], "value string")
    got = by_keys(tk.parse_trades(messages), "ticker")
    assert got["ticker"].tolist() == ["A", "B", "C"]
    assert got["timestamp"][0] == pd.Timestamp("2020-01-01 00:00:00.123")
    assert got["price"].tolist() == [1.0, 1.5, 1.5]


def test_subscriptions(spark):
    def names(*xs):
        return spark.createDataFrame([(x,) for x in xs], "ticker string")

    got = tk.subscriptions(names(" tsla", "TSLA", "", "  ", "amd", "nflx"), names("NFLX ", "gone"))
    assert sorted(r[0] for r in got.collect()) == ["AMD", "TSLA"]
    ticks = names("AMD", "AMD", "NFLX", "X")
    assert tk.subscribed_ticks(ticks, names("amd", "Amd")).count() == 2


def vendor(spark, closes, start="2024-01-01"):
    days = pd.bdate_range(start, periods=len(closes))
    frame = pd.DataFrame(
        {
            "Ticker": "AAPL", "Date": days, "Open": 1.0, "High": 2.0, "Low": 0.5, "Close": 1.5,
            "Adj Close": closes, "Volume": 10,
        }
    )
    return files.normalise_vendor(spark.createDataFrame(frame))


def test_vintages(spark):
    first = [100.0 + i for i in range(10)]
    history = ops.snapshot_baseline(vendor(spark, first))
    assert history.filter("revised or knowledge_date <> date or close <> first_print_close").count() == 0

    second = [*first]
    second[2] = 999.0
    as_of = F.lit("2024-02-01").cast("timestamp_ntz")
    history = ops.extend_history(history, vendor(spark, second), as_of)
    day3 = history.filter("date = '2024-01-03'").orderBy("knowledge_date").collect()
    assert [(r["close"], r["revised"]) for r in day3] == [(102.0, False), (999.0, True)]
    assert day3[1]["knowledge_date"] == t("2024-02-01")
    assert day3[1]["first_print_close"] == 102.0
    assert history.count() == 11

    # The same snapshot again adds nothing, a new date is added as a first print.
    later = F.lit("2024-03-01").cast("timestamp_ntz")
    assert ops.vintage_diff(history, vendor(spark, second), later).count() == 0
    added = ops.vintage_diff(history, vendor(spark, [*second, 50.0]), later).collect()
    assert [(r["close"], r["revised"]) for r in added] == [(50.0, False)]

    prints = by_keys(ops.first_prints(history), "date")["close"]
    assert prints.tolist() == first
    assert by_keys(ops.latest_prints(history), "date")["close"].tolist() == second


def test_vendor_columns(spark):
    with pytest.raises(ValueError, match="adj_close"):
        files.normalise_vendor(spark.createDataFrame([("A", 1.0)], "Ticker string, Close double"))


def test_files(spark, tmp_path):
    bars = bars_frame(spark, random_bars(5, {"a": 40, "b": 7}))
    for i, partition in enumerate([(), ("ticker",)]):
        path = str(tmp_path / f"bars{i}")
        files.write_raw_bars(bars, path, partition)
        back = files.read_raw_bars(spark, path).select(*bars.columns)
        assert back.exceptAll(bars).count() == 0 and back.count() == 47

    path = str(tmp_path / "features")
    one = features(spark, [("A", "f", 1.0, "2020-01-01", "2020-01-01")])
    two = features(spark, [("A", "f", 2.0, "2020-01-01", "2020-01-01")])
    files.write_features(one, path, "correct")
    files.write_features(one, path, "leaked")
    files.write_features(two, path, "leaked")
    assert files.read_features(spark, path, "correct").first()["value"] == 1.0
    assert [r["value"] for r in files.read_features(spark, path, "leaked").collect()] == [2.0]
