"""Reading and writing bars, features and vendor frames as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import null_if_nan
from ..schema import FEATURE_COLUMNS, FEATURES, RAW_BAR_COLUMNS, RAW_BARS

# Vendor columns kept after lower-casing and joining words with "_".
VENDOR_COLUMNS = ("date", "open", "high", "low", "close", "adj_close", "volume")


def read_raw_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_BARS).parquet(path)


def write_raw_bars(bars: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write bars ordered by (ticker, date).

    Range partitioning spreads a large ticker over several files and gives each file a narrow
    ticker range, so a filter on ticker skips row groups; one folder per ticker (pass
    ``partition_by=["ticker"]``) suits few tickers only.
    """
    ordered = bars.select(*RAW_BAR_COLUMNS).repartitionByRange("ticker", "date")
    writer = ordered.sortWithinPartitions("ticker", "date").write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def normalise_vendor(frame: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Vendor history to snake-case columns, zone-free dates and NULL instead of NaN."""
    renamed = frame.toDF(*(c.strip().lower().replace(" ", "_") for c in frame.columns))
    missing = {ticker, *VENDOR_COLUMNS} - set(renamed.columns)
    if missing:
        raise ValueError(f"vendor frame lacks columns {sorted(missing)}")
    prices = ("open", "high", "low", "close", "adj_close")
    return renamed.select(
        F.col(ticker).alias("ticker"),
        F.col("date").cast("timestamp_ntz").alias("date"),
        *(null_if_nan(F.col(c).cast("double")).alias(c) for c in prices),
        F.col("volume").cast("long").alias("volume"),
    )


def write_features(features: DataFrame, path: str, variant: str) -> None:
    """Replace one variant of the feature table and leave the others as they are."""
    (
        features.select(*FEATURE_COLUMNS)
        .withColumn("variant", F.lit(variant))
        .repartitionByRange("entity_id", "event_timestamp")
        .sortWithinPartitions("entity_id", "event_timestamp")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("variant")
        .parquet(path)
    )


def read_features(spark: SparkSession, path: str, variant: str) -> DataFrame:
    """One variant of the feature table (partition pruning, canonical columns)."""
    stored = T.StructType([*FEATURES.fields, T.StructField("variant", T.StringType())])
    table = spark.read.schema(stored).parquet(path)
    return table.filter(F.col("variant") == variant).select(*FEATURE_COLUMNS)
