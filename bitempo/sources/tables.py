"""Adapters from the star-schema and event tables to bars, ticks and vendor frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import packed, signed_to_unsigned
from ..operators.bars import daily_bars
from ..plans.hot import ROWS_PER_TASK, HotEntities, hot_entities
from ..session import tasks_for


# Stored columns of the tables in use (given schemas need no footer-reading job).
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def line_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as price prints of suppliers; ``o`` orders the prints of a day totally."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_suppkey").cast("string").alias("ticker"),
        F.col("l_shipdate").alias("date"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.col("l_quantity").alias("volume"),
        packed(
            signed_to_unsigned(F.col("l_orderkey")),
            (F.col("l_linenumber").cast("long") + (1 << 31), 10),
            # Lines that share both numbers are put in some fixed order.
            (F.pmod(F.xxhash64("l_partkey", "l_extendedprice", "l_quantity"), F.lit(100_000_000)), 8),
        ).alias("o"),
    )


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for a shuffle of the line items or of what is made of them."""
    return tasks_for(spark, table(spark, sf_dir, "lineitem").count())


def line_bars(
    spark: SparkSession, sf_dir: str, hot: HotEntities | None = None, by: Sequence[str] = ("ticker",)
) -> DataFrame:
    """Daily bars without revision dates.

    Nearly every print is a bar of its own, so nothing is combined before the shuffle. Without large suppliers
    the prints move by supplier, once: bars and the windows over them follow in the same tasks. What needs no
    windows can have them moved ``by`` other columns of a bar's key.
    """
    cols = ("ticker", "date", "price", "volume", "o")
    prints = line_prints(spark, sf_dir)
    if hot is None:
        prints = prints.repartition(line_tasks(spark, sf_dir), *by)
    return daily_bars(prints, *(F.col(c) for c in cols))


def hot_suppliers(
    spark: SparkSession, sf_dir: str, rows_per_task: int = ROWS_PER_TASK
) -> HotEntities | None:
    """Suppliers too large for one task, from a two-column scan of the line items.

    Lines bound bars, bars bound feature rows per feature, so one list serves the whole chain.
    """
    return hot_entities(line_prints(spark, sf_dir), "ticker", "date", rows_per_task)


def vendor_frame(bars: DataFrame, adj_close: Column | None = None) -> DataFrame:
    """Bars under the column names of a vendor's history download."""
    return bars.select(
        "ticker",
        F.col("date").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"),
        F.col("low").alias("Low"), F.col("close").alias("Close"),
        (F.col("close") if adj_close is None else adj_close).alias("Adj Close"),
        F.col("volume").alias("Volume"),
    )


def event_ticks(spark: SparkSession, sf_dir: str, ticker: str = "event_type") -> DataFrame:
    """Events as ticks; (timestamp, event_id) orders them totally. Timestamps stay zone-free."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col(ticker).cast("string").alias("ticker"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
        F.col("ts").alias("timestamp"),
        "event_id",
    )
