"""Landed files as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.ticks import parse_trades

# Landed files that one micro-batch takes: bounds what a backlog brings into it at once.
FILES_PER_BATCH = 64


def trade_stream(spark: SparkSession, path: str, files_per_batch: int | None = FILES_PER_BATCH) -> DataFrame:
    """Ticks from a folder of landed trade messages (one JSON text per line)."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_trades(reader.load(path))


def table_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = FILES_PER_BATCH
) -> DataFrame:
    """Any parquet folder as a stream, oldest file first."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def time_slices(df: DataFrame, time: str, parts: int) -> list[DataFrame]:
    """``parts`` consecutive ranges of equal duration (a few; each is one filtered scan).

    Rows without a time belong to the first one.
    """
    low, high = df.agg(F.min(time), F.max(time)).first()
    if low is None:
        return [df]
    step = (high - low) / parts
    slices = []
    for i in range(parts):
        start = F.lit(str(low + step * i)).cast(df.schema[time].dataType)
        end = F.lit(str(low + step * (i + 1))).cast(df.schema[time].dataType)
        part = df if i == 0 else df.filter(F.col(time) >= start)
        early = F.col(time) < end
        early = early | F.col(time).isNull() if i == 0 else early
        slices.append(part if i == parts - 1 else part.filter(early))
    return slices


def land(df: DataFrame, path: str) -> None:
    """Add the rows of one time range to a folder that a stream reads."""
    df.write.mode("append").parquet(path)
