"""Checks of the canonical feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import knowable_value, null_if_nan
from ..schema import FEATURE_COLUMNS


def conform(df: DataFrame) -> DataFrame:
    """Canonical columns in order with canonical types; NaN becomes NULL. No job is run."""
    missing = set(FEATURE_COLUMNS) - set(df.columns)
    if missing:
        raise ValueError(f"feature table lacks columns {sorted(missing)}")
    return df.select(
        F.col("entity_id").cast("string").alias("entity_id"),
        F.col("feature_name").cast("string").alias("feature_name"),
        null_if_nan(F.col("value").cast("double")).alias("value"),
        F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"),
        F.col("knowledge_timestamp").cast("timestamp_ntz").alias("knowledge_timestamp"),
    )


def enforce_rows(df: DataFrame) -> DataFrame:
    """Lazy form of the rule: reading a value known before its event fails the job."""
    event, knowledge = F.col("event_timestamp"), F.col("knowledge_timestamp")
    return df.withColumn("value", knowable_value(F.col("value"), event, knowledge))


def validate_features(df: DataFrame) -> DataFrame:
    """Conform and check the whole table at once; raises with the number of bad rows."""
    table = conform(df)
    bad = table.agg(
        F.count_if(F.col("knowledge_timestamp") < F.col("event_timestamp")).alias("bad")
    ).first()["bad"]
    if bad:
        raise ValueError(f"{bad} rows have knowledge_timestamp < event_timestamp")
    return table


def bitemporal_violations(df: DataFrame, by: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Rows checked and rows known before they were true, per group."""
    bad = F.col("knowledge_timestamp") < F.col("event_timestamp")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(bad).alias("violations")
    )
