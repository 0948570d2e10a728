"""Fixed schemas and the bitemporal rule.

``event_timestamp`` is when a fact became true, ``knowledge_timestamp`` when it could first be
known; a read at time T may only use facts with ``knowledge_timestamp <= T``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The canonical long columns and the four features of the engine.
FEATURE_COLUMNS = (
    "entity_id",
    "feature_name",
    "value",
    "event_timestamp",
    "knowledge_timestamp",
)
FEATURE_NAMES = (
    "rolling_5d_volatility",
    "rolling_20d_return",
    "volume_zscore",
    "price_momentum_10d",
)
VARIANTS = ("correct", "leaked")

FEATURES = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("feature_name", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("event_timestamp", T.TimestampNTZType()),
        T.StructField("knowledge_timestamp", T.TimestampNTZType()),
    ]
)

RAW_BARS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("first_print_close", T.DoubleType()),
        T.StructField("revised", T.BooleanType()),
        T.StructField("knowledge_date", T.TimestampNTZType()),
    ]
)
RAW_BAR_COLUMNS = tuple(RAW_BARS.fieldNames())

TICKS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source", T.StringType()),
    ]
)

LIVE_BARS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("bar_start", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("seed", T.BooleanType()),
    ]
)

TRADE_MESSAGE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "data",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("s", T.StringType()),
                        T.StructField("p", T.DoubleType()),
                        T.StructField("v", T.DoubleType()),
                        T.StructField("t", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)
