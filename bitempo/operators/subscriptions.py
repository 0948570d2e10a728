"""Subscriptions that change over time: which ticks arrived while their symbol was subscribed.

A tick reads the last change of its symbol at its own time; a change made at that instant already counts.
That is an as-of read of the changes, so ticks and changes share one pass per symbol (``plans/asof.py``):
cost is linear in both, however often a symbol was added and removed, and a hot symbol is cut along time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_symbol
from ..plans.asof import states_at
from ..plans.hot import HotEntities

_STATE = "_membership"


def cleaned_changes(changes: DataFrame) -> DataFrame:
    """Changes with a usable symbol, a time and a direction: ``ticker, at, seq, added``.

    ``seq`` (any integer) orders the changes of one symbol at one time; the last one counts. Of two with
    the same ``seq`` the addition counts.
    """
    cleaned = changes.select(
        clean_symbol(F.col("ticker")).alias("ticker"), "at", F.col("seq").cast("long").alias("seq"), "added")
    return cleaned.filter(F.col("ticker").isNotNull() & F.col("at").isNotNull() & F.col("added").isNotNull())


def subscribed_over_time(
    ticks: DataFrame, changes: DataFrame, time: str = "timestamp", hot: HotEntities | str | None = "auto"
) -> DataFrame:
    """The ticks whose symbol was subscribed when they arrived, each as often as it is there.

    ``changes``: ``ticker, at, seq, added`` (symbols are trimmed and upper-cased, blank ones skipped). Ticks
    carry clean symbols. Ticks without symbol or time, and those before the first change of their symbol,
    are not subscribed. No changes: no ticks.
    """
    facts = cleaned_changes(changes).select(
        F.col("ticker").alias("_entity_key"),
        F.col("at").cast(ticks.schema[time].dataType).alias("_t"),
        F.struct("at", "seq", "added").alias(_STATE),
    )
    others = [c for c in ticks.columns if c not in ("ticker", time)]
    # With a column to carry along, repeated ticks stay.
    spine = ticks if others else ticks.withColumn("_each", F.lit(1))
    read = states_at(spine, facts, "ticker", time, others or ["_each"], hot)
    return read.filter(F.col(_STATE)["added"]).select(*ticks.columns)
