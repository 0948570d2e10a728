"""OHLCV bars, snapshots and vintages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import order_key
from ..plans.hot import HotEntities, own_rows, resolve_hot, split_rows
from ..schema import RAW_BAR_COLUMNS

CHANGE_EPSILON = 1e-9
REVISION_LAG_BARS = 3


def build_bars(
    ticks: DataFrame, interval: str, order: Sequence[str] = ("timestamp",)
) -> DataFrame:
    """Event-time bars per ticker. ``order`` must order the ticks of a bar totally.

    Partial aggregation runs before the shuffle, so a hot ticker costs one row per bar and task.
    The still open bars are included; on a stream, the output mode decides when a bar is emitted.
    """
    key = order_key(ticks, order)
    bars = ticks.groupBy("ticker", F.window("timestamp", interval).alias("w")).agg(
        F.min_by("price", key).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", key).alias("close"),
        F.sum("volume").alias("volume"),
        F.max("timestamp").alias("timestamp"),
    )
    return bars.select(
        "ticker", F.col("w.start").alias("bar_start"),
        "open", "high", "low", "close", "volume", "timestamp",
    )


def closed_bars(bars: DataFrame, interval: str, now: Column) -> DataFrame:
    """Bars whose interval has ended by ``now``."""
    return bars.filter(F.col("bar_start") + F.expr(f"interval {interval}") <= now)


def daily_bars(
    trades: DataFrame, ticker: Column, date: Column, price: Column, volume: Column, order: Column
) -> DataFrame:
    """Daily bars; a day with several prints counts as revised (first print vs last)."""
    return (
        trades.select(
            ticker.alias("ticker"), date.alias("date"), price.alias("price"),
            volume.alias("volume"), order.alias("o"),
        )
        .groupBy("ticker", "date")
        .agg(
            F.min_by("price", "o").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "o").alias("close"),
            F.sum("volume").cast("long").alias("volume"),
            (F.count(F.lit(1)) > 1).alias("revised"),
        )
        .withColumn("first_print_close", F.col("open"))
    )


def stamp_revisions(
    bars: DataFrame, lag: int = REVISION_LAG_BARS, hot: HotEntities | str | None = "auto"
) -> DataFrame:
    """A revised bar becomes known ``lag`` bars after its own date, others on their date."""
    hot = resolve_hot(hot, bars, "ticker", "date")
    split = split_rows(bars, "ticker", "date", hot, after=lag)
    w = Window.partitionBy("ticker", "_chunk").orderBy("date")
    known = F.when(F.col("revised"), F.coalesce(F.lead("date", lag).over(w), F.col("date")))
    stamped = split.withColumn("knowledge_date", F.coalesce(known, F.col("date")))
    return own_rows(stamped).select(*RAW_BAR_COLUMNS)


def first_prints(bars: DataFrame) -> DataFrame:
    """One row per (ticker, date): the first vintage. Input of causal features."""
    return _one_vintage(bars, F.min_by)


def latest_prints(bars: DataFrame) -> DataFrame:
    """One row per (ticker, date): the last vintage."""
    return _one_vintage(bars, F.max_by)


def _one_vintage(bars: DataFrame, pick) -> DataFrame:
    # The key stays outside: what is partitioned by it is known to be so afterwards.
    rest = [c for c in RAW_BAR_COLUMNS if c not in ("ticker", "date")]
    row = pick(F.struct(*rest), F.struct("knowledge_date", "revised", "close"))
    return bars.groupBy("ticker", "date").agg(row.alias("r")).select("ticker", "date", "r.*")


def snapshot_baseline(vendor: DataFrame) -> DataFrame:
    """First snapshot of a normalised vendor frame: adjusted close, known on its own date."""
    return vendor.select(
        "ticker", "date", "open", "high", "low",
        F.col("adj_close").alias("close"),
        "volume",
        F.col("adj_close").alias("first_print_close"),
        F.lit(False).alias("revised"),
        F.col("date").alias("knowledge_date"),
    )


def vintage_diff(history: DataFrame, snapshot: DataFrame, as_of: Column) -> DataFrame:
    """Rows that ``snapshot`` (a normalised vendor frame) adds to ``history``.

    The latest stored row of each (ticker, date) is compared with the snapshot's adjusted close.
    A change gives a revision row known at ``as_of``, also where the stored close is missing; a date
    never seen gives a first print. A close that a later snapshot lacks is no correction: what is
    stored stays. Stored rows are never touched, and an unchanged snapshot adds nothing.
    """
    last = latest_prints(history)
    fresh = snapshot_baseline(snapshot)
    joined = last.alias("old").join(fresh.alias("new"), ["ticker", "date"], "full_outer")
    is_new = F.col("old.close").isNull() & F.col("old.knowledge_date").isNull()
    changed = F.abs(F.col("new.close") - F.col("old.close")) > CHANGE_EPSILON
    differs = F.col("new.close").isNotNull() & F.coalesce(changed, F.lit(True))

    def pick(name: str) -> Column:
        return F.when(is_new, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    added = joined.filter(is_new | differs)
    return added.select(
        "ticker", "date", *(pick(c) for c in ("open", "high", "low")),
        F.col("new.close").alias("close"),
        pick("volume"),
        pick("first_print_close"),
        (~is_new).alias("revised"),
        F.when(is_new, F.col("date")).otherwise(as_of.cast("timestamp_ntz")).alias("knowledge_date"),
    )


def extend_history(history: DataFrame, snapshot: DataFrame, as_of: Column) -> DataFrame:
    """History with the rows of ``vintage_diff`` appended."""
    return history.select(*RAW_BAR_COLUMNS).unionByName(vintage_diff(history, snapshot, as_of))
