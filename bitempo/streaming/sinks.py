"""Log, latest values, counters and update messages of running streams.

Each sink writes one folder per micro-batch and overwrites it if the batch is run again, so a
restart adds nothing twice.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import order_key
from ..operators.online import latest_values, update_events
from ..schema import FEATURE_COLUMNS, FEATURES
from ..session import exists, small_splits

LOGGED = T.StructType([*FEATURES.fields, T.StructField("batch", T.LongType())])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The versioned log (the ``batch`` column tells which micro-batch wrote a row)."""
    return spark.read.schema(LOGGED).parquet(f"{path}/log")


def _snapshot(spark: SparkSession, path: str, before: int | None = None) -> tuple[DataFrame, int]:
    """Newest complete snapshot of latest values and its batch, or an empty one at -1."""
    newest = None
    if exists(spark, f"{path}/snapshots_done"):
        # The marker files hold one line per snapshot.
        marks = spark.read.schema("batch long").json(f"{path}/snapshots_done")
        done = marks.filter(F.col("batch") < before) if before is not None else marks
        newest = done.agg(F.max("batch")).first()[0]
    if newest is None:
        return spark.createDataFrame([], FEATURES), -1
    return spark.read.schema(FEATURES).parquet(f"{path}/snapshots/{newest}"), newest


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Current value of every (entity, feature): newest snapshot plus the log written since."""
    base, at = _snapshot(spark, path)
    since = read_log(spark, path).filter(F.col("batch") > at)
    return latest_values(base.unionByName(since.select(*FEATURE_COLUMNS)))


def log_sink(path: str, snapshot_every: int = 10):
    """A ``foreachBatch`` function: append the batch to the log, fold the log now and then.

    The log folder of a batch is replaced as a whole, so replaying a batch changes nothing. A
    snapshot costs one pass over the latest values and the log written since the one before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        (
            batch.select(*FEATURE_COLUMNS)
            .write.mode("overwrite")
            .parquet(f"{path}/log/batch={batch_id}")
        )
        if (batch_id + 1) % snapshot_every == 0:
            base, at = _snapshot(spark, path, before=batch_id)
            since = read_log(spark, path).filter(F.col("batch").between(at + 1, batch_id))
            folded = latest_values(base.unionByName(since.select(*FEATURE_COLUMNS)))
            target = f"{path}/snapshots/{batch_id}"
            folded.select(*FEATURE_COLUMNS).write.mode("overwrite").parquet(target)
            mark = spark.createDataFrame([(json.dumps({"batch": batch_id}),)], "value string")
            mark.write.mode("overwrite").text(f"{path}/snapshots_done/at={batch_id}")

    return write


def start_log(
    features: DataFrame, path: str, checkpoint: str, snapshot_every: int = 10
) -> StreamingQuery:
    """Write a stream of long feature rows to log and latest values."""
    small_splits(features.sparkSession)
    return (
        features.writeStream.foreachBatch(log_sink(path, snapshot_every))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_update_events(vectors: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write one JSON message per new vector."""
    return (
        update_events(vectors, "knowledge_timestamp").select("value").writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def tick_counters(ticks: DataFrame, order: Sequence[str]) -> DataFrame:
    """Running tick count and last tick per ticker; state is one row per ticker."""
    key = order_key(ticks, order)
    return ticks.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("tick_count"),
        F.max_by("price", key).alias("last_price"),
        F.max_by("volume", key).alias("last_volume"),
        F.max_by("timestamp", key).alias("last_update"),
    )


def start_counters(counters: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep changed counters per micro-batch; ``read_counters`` gives the current ones."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counters.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    changed = spark.read.parquet(path)
    fields = [c for c in changed.columns if c not in ("ticker", "batch")]
    newest = F.max_by(F.struct(*fields), "batch").alias("s")
    return changed.groupBy("ticker").agg(newest).select("ticker", "s.*")
