"""What writing a stored feature table leaves behind, and what a read of its large entities moves."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from bitempo.operators.pit import pit_join
from bitempo.plans.hot import hot_entities
from bitempo.sources import feature_store

from .test_moves import moves

STORE = "entity_id string, feature_name string, value double, event_timestamp timestamp_ntz, knowledge_timestamp timestamp_ntz"
START = dt.datetime(2024, 1, 1)


def day(n: float) -> dt.datetime:
    return START + dt.timedelta(days=n)


def long_rows(spark):
    """Entities a and b hold 80 rows each, c to h eight; every fourth fact is revised, one value is missing."""
    sizes = dict.fromkeys("ab", 40) | dict.fromkeys("cdefgh", 4)
    rows = [(e, f, float(i) if i != 3 else None, day(i), day(i + 5 * (i % 4 == 0)))
            for e, n in sizes.items() for i in range(n) for f in ("x", "y")]
    return spark.createDataFrame(rows, STORE)


def requests(spark):
    """d is asked for as often as the large ones; some requests repeat."""
    rows = [(e, day(i + 0.5)) for e, n in {"a": 20, "c": 5, "d": 60, "z": 3}.items() for i in range(n)]
    return spark.createDataFrame([*rows, *rows[:4], (None, day(1)), ("a", None)], "entity_id string, request_time timestamp_ntz")


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    name = f"reads_{os.path.basename(tmp_path)}"
    yield feature_store.write_store(long_rows(spark), str(tmp_path / "store"), name, 3, 30)
    spark.sql(f"DROP TABLE {name}")


def test_large_entities_move_once(spark, store, monkeypatch):
    monkeypatch.setattr("bitempo.session.MIN_TASK_ROWS", 10)
    read = feature_store.stored_join(requests(spark), store, features=("x", "y"))
    # The requests of either part, and the rows of the large part.
    assert moves(read) == 3
    want = rows_of(pit_join(requests(spark), long_rows(spark), ("x", "y"), hot=None))
    assert rows_of(read) == want and len(want) > 60


@pytest.mark.parametrize("order", ["event", "knowledge"])
def test_large_entities_are_still_cut(spark, store, order, monkeypatch):
    cut = []

    def few(rows, entity, time, rows_per_task=15):
        cut.append(hot_entities(rows, entity, time, rows_per_task))
        return cut[-1]

    monkeypatch.setattr(feature_store, "hot_entities", few)
    read = feature_store.stored_join(requests(spark), store, order, features=("x", "y"))
    assert len(cut) == 2 and cut[1] is not None
    assert rows_of(read) == rows_of(pit_join(requests(spark), long_rows(spark), ("x", "y"), order, hot=None))


def test_very_many_names_are_not_sent_to_every_task(spark, store, monkeypatch):
    monkeypatch.setattr(feature_store, "MOST_LISTED", 1)
    names = spark.createDataFrame([("a",), ("b",)], "_entity string")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(feature_store._listed(names.limit(1))) and not hinted(feature_store._listed(names))
    read = feature_store.stored_join(requests(spark), store, features=("x", "y"))
    assert rows_of(read) == rows_of(pit_join(requests(spark), long_rows(spark), ("x", "y"), hot=None))


def test_rows_written_for_the_passes_go_with_them(spark, store):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert store.large.count() == 160
    assert not [f for f in os.listdir(f"{root}/bitempo") if f.startswith("store-rows")]
