"""Late ticks kept: a stream split by its own watermark into applied and late rows.

The mark of a micro-batch is the newest time of all earlier ones. A tick is late if the bar it belongs to had
ended ``delay`` before that mark: a bar stream with this delay would drop it unseen. Here it goes to a
folder of its own. Rows and marks are written per micro-batch and replaced as a whole when a batch is run
again, which sees the same mark, so nothing is lost or doubled: applied and late rows are all rows.

What is applied never falls behind the watermark of a bar stream over it, provided that stream takes the
micro-batches in order and each one whole (``files_per_batch=None``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import exists


def mark_before(spark: SparkSession, path: str, batch_id: int):
    """Newest time of the batches before this one, or None."""
    if not exists(spark, f"{path}/marks"):
        return None
    marks = spark.read.schema("newest timestamp, batch long").parquet(f"{path}/marks")
    return marks.filter(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]


def late_split(path: str, interval: str, delay: str):
    """A ``foreachBatch`` function: rows to ``rows/batch=n/late=...``, the newest time to ``marks``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = mark_before(spark, path, batch_id)
        end = F.window("timestamp", interval)["end"]
        late = F.lit(False) if mark is None else F.coalesce(
            end <= F.lit(mark) - F.expr(f"interval {delay}"), F.lit(False))
        rows = f"{path}/rows/batch={batch_id}"
        # Rows without a time have no window: they are applied, as the batch form keeps them.
        untimed = batch.filter(F.col("timestamp").isNull()).withColumn("late", F.lit(False))
        tagged = batch.filter(F.col("timestamp").isNotNull()).withColumn("late", late).unionByName(untimed)
        # Static mode: the folder is replaced as a whole, also where a rerun has no late row any more.
        tagged.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("late").parquet(rows)
        written = spark.read.schema(batch.schema).parquet(rows)
        written.agg(F.max("timestamp").alias("newest")).write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")

    return write


def start_late_split(ticks: DataFrame, path: str, checkpoint: str, interval: str, delay: str) -> StreamingQuery:
    return (
        ticks.writeStream.foreachBatch(late_split(path, interval, delay))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def split_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a split stream with the flag ``late``."""
    kind = T.StructType([*schema.fields, T.StructField("late", T.BooleanType())])
    return spark.read.schema(kind).option("basePath", f"{path}/rows").parquet(f"{path}/rows/*")


def applied_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The applied rows as a stream, each micro-batch whole."""
    kind = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("late", T.BooleanType())])
    rows = spark.readStream.schema(kind).parquet(f"{path}/rows")
    return rows.filter(~F.col("late")).drop("late", "batch")
