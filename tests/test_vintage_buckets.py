"""The vintage store keeps its rows in place: what a pull moves and leaves behind."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from bitempo.catalog import queries
from bitempo.operators.bars import snapshot_baseline, vintage_diff
from bitempo.session import freed_shuffles, write_buckets
from bitempo.sources import vintages

from .test_moves import lines, moves  # noqa: F401

VENDOR = "ticker string, date timestamp_ntz, open double, high double, low double, adj_close double, volume long"
DATES = [dt.datetime(2020, m, 1) for m in (2, 3, 4)]


def frame(spark, shift, tickers=("a", "b", None)):
    rows = [(t, dt.datetime(2019, 1, 1) + dt.timedelta(days=i) if i else None, 1.0, 2.0, 0.5, float(i + shift * (i % 3 == 1)), 7)
            for t in tickers for i in range(20)]
    return spark.createDataFrame([*rows, rows[4]], VENDOR)


def pulls(spark):
    return [frame(spark, 0), frame(spark, 1), frame(spark, 2, ("a", "b", "c"))]


def expected(spark):
    """The three pulls by the operators alone."""
    first, *later = pulls(spark)
    history = snapshot_baseline(first)
    for snapshot, date in zip(later, DATES[1:]):
        history = history.unionByName(vintage_diff(history, snapshot, F.lit(str(date)).cast("timestamp_ntz")))
    return sorted(map(str, history.collect()))


def shuffle_files(spark) -> set[str]:
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    blocks = disk.getAllBlocks()
    return {name for i in range(blocks.size()) if (name := blocks.apply(i).name()).startswith("shuffle_")}


def left_over(spark, before: set[str]) -> set[str]:
    """What was shuffled since and is still there; it is deleted in the background."""
    until = time.time() + 5
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return left


def test_stored_rows_and_partitioned_snapshots_do_not_move(spark, tmp_path, monkeypatch):
    path, wrote = str(tmp_path / "store"), []
    monkeypatch.setattr(vintages, "write_buckets", lambda df, *rest: (wrote.append(moves(df)), write_buckets(df, *rest)))
    for i, (snapshot, date) in enumerate(zip(pulls(spark), DATES)):
        placed = write_buckets(snapshot, str(tmp_path / f"snapshot-{i}"), 3, vintages.KEYS)
        vintages.add_pull(spark, path, placed, date, 3)
    assert wrote == [0, 0, 0]
    again = str(tmp_path / "plain")
    for snapshot, date in zip(pulls(spark), DATES):
        vintages.add_pull(spark, again, snapshot, date, 3)
    assert wrote[3:] == [1, 1, 1]
    want = expected(spark)
    for place in (path, again):
        assert sorted(map(str, vintages.read_vintages(spark, place).collect())) == want and len(want) > 70


def test_a_rerun_moves_its_difference_only(spark, tmp_path, monkeypatch):
    path, compared = str(tmp_path / "store"), []
    placed = [write_buckets(s, str(tmp_path / f"snapshot-{i}"), 3, vintages.KEYS) for i, s in enumerate(pulls(spark))]
    for snapshot, date in zip(placed, DATES):
        vintages.add_pull(spark, path, snapshot, date, 3)
    kept = vintages.stage
    monkeypatch.setattr(vintages, "stage", lambda df, name: (compared.append((name, moves(df))), kept(df, name))[1])
    for snapshot, date in zip(placed, DATES):
        vintages.add_pull(spark, path, snapshot, date)
    # A baseline is compared in place; of later pulls only what they add moves.
    assert compared == [("pull-differs", 0), ("pull-differs", 1), ("pull-differs", 1)]
    assert sorted(map(str, vintages.read_vintages(spark, path).collect())) == expected(spark)


def test_a_store_without_buckets_goes_on_without(spark, tmp_path):
    path, (first, *later) = str(tmp_path / "old"), pulls(spark)
    snapshot_baseline(first).write.parquet(f"{path}/pull={DATES[0]:%Y-%m-%dT%H-%M-%S}")
    for snapshot, date in zip(later, DATES[1:]):
        vintages.add_pull(spark, path, snapshot, date, 3)
    vintages.add_pull(spark, path, first, DATES[0], 3)
    assert vintages.stored_buckets(spark, path) is None
    assert sorted(map(str, vintages.read_vintages(spark, path).collect())) == expected(spark)
    with pytest.raises(ValueError, match="later pulls"):
        vintages.add_pull(spark, path, later[0], DATES[0])


def test_pulls_leave_no_shuffles(spark, tmp_path):
    before, path = shuffle_files(spark), str(tmp_path / "store")
    for snapshot, date in zip(pulls(spark)[:2], DATES):
        vintages.add_pull(spark, path, snapshot, date, 3)
    vintages.add_pull(spark, path, pulls(spark)[0], DATES[0])
    assert not left_over(spark, before)
    # The setting is that of the block only.
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), freed_shuffles(spark):
        assert spark.conf.get(key) == "true"
        1 / 0
    assert spark.conf.get(key) == was


def test_rerun_query_makes_its_bars_once(spark, lines, monkeypatch):  # noqa: F811
    made, kept = [], queries.line_bars
    monkeypatch.setattr(queries, "line_bars", lambda *a: (made.append(a[3:]), kept(*a))[1])
    rows = queries.QUERIES["vintage_store_rerun"](spark, lines)
    assert made == [(vintages.KEYS,)]
    assert rows.count() > rows.select("ticker", "date").distinct().count() > 300


def test_store_query_makes_its_bars_once(spark, lines, monkeypatch):  # noqa: F811
    made, kept = [], queries.line_bars
    monkeypatch.setattr(queries, "line_bars", lambda *a: (made.append(a[3:]), kept(*a))[1])
    rows = queries.QUERIES["vintage_store"](spark, lines)
    assert made == [(vintages.KEYS,)] and rows.filter("revised").count() > 0
