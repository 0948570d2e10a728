"""Bars since the last flush, late ticks, seeded features, status: against plain loops and against each other."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bitempo.catalog.queries import TICK_ROWS
from bitempo.operators.bars import snapshot_baseline
from bitempo.operators import flush
from bitempo.operators.flush import flush_bars, flushes, leaving
from bitempo.operators.online import live_bars, ticker_status
from bitempo.plans.hot import hot_entities
from bitempo.schema import FEATURE_NAMES, LIVE_BARS
from bitempo.sources import vintages
from bitempo.streaming import late, live, sinks, stateful
from bitempo.streaming import sources as src

from .helpers import by_keys

ORDER = ("timestamp", "event_id")


def ticks_of(spark, tickers, n, seed, span=172_800):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({
        "ticker": rng.choice(tickers, n), "price": rng.random(n) + 10, "volume": rng.integers(1, 9, n).astype(float),
        "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, span, n), "s"),
        "source": "test", "event_id": np.arange(n)})
    return spark.createDataFrame(frame, TICK_ROWS)


def buffered(frame: pd.DataFrame, seconds: int, with_open: bool):
    """The bars of a buffer that is handed one tick after the other."""
    out = []
    for ticker, own in frame.sort_values(["timestamp", "event_id"]).groupby("ticker"):
        since, held = None, []
        for r in own.itertuples():
            since = r.timestamp if since is None else since
            held.append(r)
            if (r.timestamp - since).total_seconds() >= seconds:
                out.append((ticker, since, held))
                since, held = r.timestamp, []
        if held and with_open:
            out.append((ticker, since, held))
    return sorted((t, s, h[0].price, max(x.price for x in h), min(x.price for x in h), h[-1].price,
                   sum(x.volume for x in h), h[-1].timestamp, len(h)) for t, s, h in out)


@pytest.mark.parametrize("rows_per_task,with_open", [(None, False), (None, True), (25, True), (7, False)])
def test_flush_bars(spark, rows_per_task, with_open):
    # Many ticks share a second; one ticker has a single tick.
    ticks = ticks_of(spark, ["A", "A", "A", "B"], 900, 3, span=9_000).unionByName(
        ticks_of(spark, ["C"], 1, 4)).unionByName(ticks_of(spark, ["A"], 60, 5, span=400_000).withColumn("event_id", F.col("event_id") + 5000))
    hot = None if rows_per_task is None else hot_entities(ticks, "ticker", "timestamp", rows_per_task)
    assert rows_per_task is None or hot is not None
    odd = spark.createDataFrame([(None, 1.0, 1.0, None, "test", 1), ("A", 1.0, 1.0, None, "test", 1)], TICK_ROWS)
    got = flush_bars(ticks.unionByName(odd), 600, ORDER, hot, with_open)
    want = buffered(ticks.toPandas(), 600, with_open)
    assert len(want) > 20
    assert sorted(tuple(r) for r in got.collect()) == [
        (t, s.to_pydatetime(), *rest[:5], rest[5].to_pydatetime(), rest[6]) for t, s, *rest in want]
    assert flush_bars(ticks.limit(0), 600, ORDER, None).count() == 0


def test_small_chunks_take_few_rounds_and_linear_frames(spark, monkeypatch):
    """Two hundred chunks within a few intervals: as many doublings as flushes ask for, no frame built per row."""
    rows = [("a", 1.0 + i, 1.0, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=7 * i), i) for i in range(400)]
    ticks = spark.createDataFrame(rows, "ticker string, price double, volume double, timestamp timestamp_ntz, event_id long")
    staged = []
    kept = flush.stage

    def watched(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        staged.append((name, "unboundedfollowing" in plan))
        return kept(df, name)

    monkeypatch.setattr(flush, "stage", watched)
    key = ["ticker", "since"]
    got = by_keys(flush_bars(ticks, 600, ORDER, hot_entities(ticks, "ticker", "timestamp", 2)), *key)
    assert got.equals(by_keys(flush_bars(ticks, 600, ORDER, None), *key)) and len(got) == 4
    assert not any(quadratic for _, quadratic in staged)
    # 2,793 seconds hold five flushes at most: three rounds and the first table.
    assert sum(name == "flush-jumps" for name, _ in staged) == 4


def test_chains_leave_where_they_flush_last():
    times = np.cumsum(np.random.default_rng(1).integers(0, 40, 300))
    out = leaving(times, 100)
    for i in range(0, 300, 7):
        own = flushes(times, int(times[i]), 100)
        assert times[out[i]] == (times[own[-1]] if own else times[i])


def split(spark, root, parts):
    for part in parts:
        src.land(part.coalesce(1), f"{root}/ticks")
        source = src.table_stream(spark, f"{root}/ticks", TICK_ROWS)
        late.start_late_split(source, f"{root}/split", f"{root}/ck", "1 hour", "30 minutes").awaitTermination()
    return late.split_rows(spark, f"{root}/split", TICK_ROWS)


def test_late_rows_are_kept_and_the_rest_is_never_dropped(spark, tmp_path):
    root, ticks = str(tmp_path), ticks_of(spark, ["A", "B"], 500, 8)
    one, two, three = src.time_slices(ticks, "timestamp", 3)
    held = F.col("event_id") % 9 == 0
    nothing = spark.createDataFrame([("A", 1.0, 1.0, None, "test", 9_999)], TICK_ROWS)
    parts = [one.filter(~held).unionByName(nothing), two, three.unionByName(one.filter(held))]
    rows = split(spark, root, parts)
    assert rows.count() == 501 and 0 < rows.filter("late").count() < 200
    assert rows.filter("late").join(one.filter(held), "event_id", "left_anti").count() == 0
    kept = sorted(map(tuple, rows.collect()), key=repr)

    # A batch that is run again replaces its own folder.
    late.late_split(f"{root}/split", "1 hour", "30 minutes")(spark.read.schema(TICK_ROWS).parquet(f"{root}/ticks").join(
        parts[2].select("event_id"), "event_id").select(*TICK_ROWS.fieldNames()), 2)
    assert sorted(map(tuple, late.split_rows(spark, f"{root}/split", TICK_ROWS).collect()), key=repr) == kept

    # A bar stream over the applied rows takes every one of them.
    rows = late.split_rows(spark, f"{root}/split", TICK_ROWS)
    bars = live.bar_stream(late.applied_stream(spark, f"{root}/split", TICK_ROWS), "1 hour", "30 minutes", ORDER)
    live.run_available(bars, f"{root}/bars", f"{root}/bars-ck")
    got = spark.read.schema(LIVE_BARS).parquet(f"{root}/bars")
    applied = rows.filter(~F.col("late") & F.col("timestamp").isNotNull())
    want = live_bars(applied, "1 hour", ORDER).join(got.select("ticker", "bar_start"), ["ticker", "bar_start"])
    pd.testing.assert_frame_equal(by_keys(got, "ticker", "bar_start"), by_keys(want.select(*LIVE_BARS.fieldNames()), "ticker", "bar_start"))


def features_of(spark, root, parts, history=None, make=None):
    for part in parts:
        src.land(part, f"{root}/bars")
        bars = src.table_stream(spark, f"{root}/bars", LIVE_BARS)
        live.run_available(make(bars, history), f"{root}/features", f"{root}/features-ck")
    return by_keys(spark.read.schema(live.VECTORS).parquet(f"{root}/features"), "entity_id", "event_timestamp")


def test_seeded_features(spark, tmp_path):
    stateful.use_rocksdb(spark)
    ticks = ticks_of(spark, ["A", "B", "C"], 2000, 6)
    bars = live_bars(ticks, "30 minutes", ORDER).filter("ticker <> 'C' or hour(bar_start) < 8")

    def seeded(b, history):
        return stateful.seeded_feature_stream(b, history, "30 minutes")

    def plain(b, _):
        return live.feature_stream(b, "30 minutes")

    parts = src.time_slices(bars, "bar_start", 3)
    new, old = (features_of(spark, str(tmp_path / name), parts, None, make) for name, make in (("new", seeded), ("old", plain)))
    assert len(new) > 50
    pd.testing.assert_frame_equal(new, old)
    # Seeded with what comes before a cut, the stream emits from its first bar, as the unseeded one would have.
    cut = F.lit("2024-01-01 22:00:00").cast("timestamp")
    past, live_part = bars.filter(F.col("bar_start") < cut), bars.filter(F.col("bar_start") >= cut)
    seed = features_of(spark, str(tmp_path / "seed"), src.time_slices(live_part, "bar_start", 2), past, seeded)
    want = old[old["event_timestamp"] >= pd.Timestamp("2024-01-01 22:00:00")].reset_index(drop=True)
    assert seed["event_timestamp"].min() == pd.Timestamp("2024-01-01 22:00:00")
    for f in FEATURE_NAMES:
        np.testing.assert_allclose(seed[f], want[f], rtol=1e-9)


def test_status_equals_the_batch_form(spark, tmp_path):
    stateful.use_rocksdb(spark)
    root, ticks = str(tmp_path), ticks_of(spark, ["A", "B", "B", "B"], 700, 2)
    # Parts are not in order of time.
    for k in (1, 0, 2):
        src.land(ticks.filter(F.col("event_id") % 3 == k), f"{root}/ticks")
        source = src.table_stream(spark, f"{root}/ticks", TICK_ROWS)
        status = stateful.status_stream(source, "1 hour", "event_id")
        sinks.start_counters(status, f"{root}/status", f"{root}/ck").awaitTermination()
    want = by_keys(ticker_status(ticks, "1 hour", ORDER), "ticker")
    got = by_keys(sinks.read_counters(spark, f"{root}/status"), "ticker")
    pd.testing.assert_frame_equal(got[list(want.columns)], want, check_dtype=False)


# --- vintage store ------------------------------------------------------------------------------


def vendor(spark, closes):
    rows = [("T", dt.datetime(2020, 1, 1 + i), c, c, c, c, 10) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, date timestamp_ntz, open double, high double, low double, adj_close double, volume long")


PULLS = [(10.0, 20.0), (11.0, 20.0, 30.0), (11.0, 21.0, 30.0)]


@pytest.mark.parametrize("again", [0, 1, 2])
def test_a_pull_that_is_run_again_changes_nothing(spark, tmp_path, again):
    path = str(tmp_path / "store")
    dates = [dt.datetime(2020, m, 1) for m in (2, 3, 4)]
    for closes, date in zip(PULLS, dates):
        vintages.add_pull(spark, path, vendor(spark, closes), date)
    before = sorted(map(tuple, vintages.read_vintages(spark, path).collect()))
    assert sum(r[8] for r in before) == 2 and before[0][9] == dt.datetime(2020, 1, 1)
    vintages.add_pull(spark, path, vendor(spark, PULLS[again]), dates[again])
    assert sorted(map(tuple, vintages.read_vintages(spark, path).collect())) == before
    first = snapshot_baseline(vendor(spark, PULLS[0])).collect()
    assert {tuple(r) for r in first} <= set(before)
    if again < 2:
        with pytest.raises(ValueError, match="later pulls"):
            vintages.add_pull(spark, path, vendor(spark, (10.0, 99.0)), dates[again])
        assert sorted(map(tuple, vintages.read_vintages(spark, path).collect())) == before
    else:
        vintages.add_pull(spark, path, vendor(spark, PULLS[0]), dates[2])
        after = vintages.read_vintages(spark, path).filter("knowledge_date = timestamp_ntz'2020-04-01 00:00:00'")
        assert [(r.close, r.first_print_close) for r in after.collect()] == [(10.0, 10.0)]


def test_a_pull_is_written_once(spark, tmp_path, monkeypatch):
    """A new pull goes straight to its folder; one that finds what is stored leaves the files alone."""
    path, staged = f"file://{tmp_path}/store", []
    kept = vintages.stage
    monkeypatch.setattr(vintages, "stage", lambda df, name: staged.append(name) or kept(df, name))
    columns = "ticker string, date timestamp_ntz, open double, high double, low double, close double, adj_close double, volume long"
    rows = [(t, dt.datetime(2024, 1, d), 1.0, 1.0, 1.0, 1.0, float(d), 5) for t in ("a", None) for d in (1, 2, 2)]
    first = spark.createDataFrame(rows, columns)
    second = first.withColumn("adj_close", F.col("adj_close") + 1)
    for snapshot, day in ((first, 5), (second, 6)):
        vintages.add_pull(spark, path, snapshot, dt.datetime(2024, 1, day))
    assert not staged
    files = sorted((p, p.stat().st_mtime_ns) for p in (tmp_path / "store").rglob("*.parquet"))
    for snapshot, day in ((first, 5), (second, 6)):
        vintages.add_pull(spark, path, snapshot, dt.datetime(2024, 1, day))
    assert len(staged) == 2
    assert sorted((p, p.stat().st_mtime_ns) for p in (tmp_path / "store").rglob("*.parquet")) == files
    # The newest pull may be replaced, an older one not; one more copy of a row is a difference.
    with pytest.raises(ValueError, match="later pulls"):
        vintages.add_pull(spark, path, first.unionByName(first.limit(1)), dt.datetime(2024, 1, 5))
    vintages.add_pull(spark, path, first, dt.datetime(2024, 1, 6))
    assert vintages.read_vintages(spark, path).filter("ticker = 'a'").count() == 3
