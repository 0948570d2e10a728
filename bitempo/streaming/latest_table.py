"""Latest values as a keyed table in hash buckets: a fold rewrites only the buckets that its delta touches.

Three kinds of folders under one path:

* ``log/batch=n``: the rows of a micro-batch, replaced as a whole when it is run again;
* ``segments/upto=n``: the log folders of one fold, compacted into as many files as rows need;
* ``values/version=n/bucket=b``: the latest values of bucket b as of fold n, and ``folds/upto=n``, one row per
  bucket with the version that holds it, written last: a fold without it never happened.

A fold reads the log written since the fold before and the touched buckets, so its cost follows the delta and
not the table. Keys, not rows, are hashed: a key with a third of the log is one row of one bucket, and its
delta rows are combined before they move. Lists of touched buckets are bounded by the number of buckets,
which is fixed when the table is begun. What a fold replaced stays for ``KEPT_FOLDS`` folds, so that
readers of an earlier state can finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.online import latest_values
from ..schema import FEATURE_COLUMNS, FEATURES
from ..session import exists, small_splits
from .sinks import LOGGED

BUCKETS = 256
KEPT_FOLDS = 3
ROWS_PER_FILE = 5_000_000
FOLDS = "bucket int, version long, buckets int, upto long"


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("entity_id", "feature_name"), F.lit(buckets)).cast("int")


def folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers n of the folders ``<path>/<name>=n``, ascending."""
    if not exists(spark, path):
        return []
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    entries = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    names = [e.getPath().getName() for e in entries]
    return sorted(int(n.removeprefix(f"{name}=")) for n in names if n.startswith(f"{name}="))


def finished(spark: SparkSession, path: str, name: str) -> list[int]:
    """As ``folders``, without those whose write did not end."""
    return [n for n in folders(spark, path, name) if exists(spark, f"{path}/{name}={n}/_SUCCESS")]


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def versions_at(spark: SparkSession, path: str, fold: int | None) -> dict[int, int]:
    """Bucket to version as of a fold; buckets that never had a row are absent."""
    if fold is None:
        return {}
    rows = spark.read.schema(FOLDS).parquet(f"{path}/folds/upto={fold}").select("bucket", "version").collect()
    return {r.bucket: r.version for r in rows}


def values_of(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame:
    """The stored rows of some buckets."""
    if not versions:
        return spark.createDataFrame([], FEATURES)
    parts = [f"{path}/values/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(FEATURES).parquet(*parts)


def log_between(spark: SparkSession, path: str, after: int, upto: int | None = None) -> DataFrame:
    """Log rows of the micro-batches after one and up to another that no segment holds."""
    due = [n for n in finished(spark, f"{path}/log", "batch") if n > after and (upto is None or n <= upto)]
    if not due:
        return spark.createDataFrame([], LOGGED)
    reader = spark.read.schema(LOGGED).option("basePath", f"{path}/log")
    return reader.parquet(*(f"{path}/log/batch={n}" for n in due))


def last_fold(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    done = [n for n in finished(spark, f"{path}/folds", "upto") if before is None or n < before]
    return done[-1] if done else None


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The whole versioned log: compacted segments and the folders written since."""
    fold = last_fold(spark, path)
    since = log_between(spark, path, -1 if fold is None else fold)
    if fold is None:
        return since
    kept = [n for n in finished(spark, f"{path}/segments", "upto") if n <= fold]
    stored = spark.read.schema(LOGGED).parquet(*(f"{path}/segments/upto={n}" for n in kept))
    return stored.unionByName(since)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Current value of every (entity, feature): the buckets plus the log written since the last fold."""
    fold = last_fold(spark, path)
    base = values_of(spark, path, versions_at(spark, path, fold))
    since = log_between(spark, path, -1 if fold is None else fold).select(*FEATURE_COLUMNS)
    return latest_values(base.unionByName(since))


def fold(spark: SparkSession, path: str, batch_id: int, buckets: int = BUCKETS) -> list[int]:
    """Bring the table up to a micro-batch; returns the buckets that were rewritten.

    Run again, it starts from the fold before and writes the same; log folders are removed only when a
    later fold finds this one finished.
    """
    before = last_fold(spark, path, batch_id)
    begun = -1 if before is None else before
    versions = versions_at(spark, path, before)
    if before is not None:
        has = spark.read.schema(FOLDS).parquet(f"{path}/folds/upto={before}").agg(F.max("buckets")).first()[0]
        if has not in (None, buckets):
            raise ValueError(f"the table has {has} buckets")
        for n in folders(spark, f"{path}/log", "batch"):
            if n <= before:
                remove(spark, f"{path}/log/batch={n}")
    segment = f"{path}/segments/upto={batch_id}"
    delta = log_between(spark, path, begun, batch_id)
    delta.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(segment)
    delta = spark.read.schema(LOGGED).parquet(segment)
    newest = latest_values(delta.select(*FEATURE_COLUMNS))
    touched = sorted(r.b for r in newest.select(bucket_of(buckets).alias("b")).distinct().collect())
    if touched:
        old = values_of(spark, path, {b: versions[b] for b in touched if b in versions})
        merged = latest_values(old.unionByName(newest)).withColumn("bucket", bucket_of(buckets))
        (
            merged.repartition("bucket").sortWithinPartitions("bucket", "entity_id", "feature_name")
            .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket")
            .parquet(f"{path}/values/version={batch_id}")
        )
    versions |= {b: batch_id for b in touched}
    rows = [(b, v, buckets, batch_id) for b, v in sorted(versions.items())]
    spark.createDataFrame(rows, FOLDS).coalesce(1).write.mode("overwrite").parquet(f"{path}/folds/upto={batch_id}")
    _retire(spark, path)
    return touched


def _retire(spark: SparkSession, path: str) -> None:
    """Remove stored buckets that none of the last folds refers to, and the lists of older folds."""
    done = finished(spark, f"{path}/folds", "upto")
    recent = done[-KEPT_FOLDS:]
    used = {(b, v) for n in recent for b, v in versions_at(spark, path, n).items()}
    for version in folders(spark, f"{path}/values", "version"):
        if version > recent[-1]:
            continue
        place = f"{path}/values/version={version}"
        own = folders(spark, place, "bucket")
        live = [b for b in own if (b, version) in used]
        if not live:
            remove(spark, place)
        for b in set(own) - set(live) if live else ():
            remove(spark, f"{place}/bucket={b}")
    for n in set(done) - set(recent):
        remove(spark, f"{path}/folds/upto={n}")


def bucketed_sink(path: str, fold_every: int = 10, buckets: int = BUCKETS):
    """A ``foreachBatch`` function: append the batch to the log, fold every few batches."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.select(*FEATURE_COLUMNS).write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")
        if (batch_id + 1) % fold_every == 0:
            fold(spark, path, batch_id, buckets)

    return write


def start_bucketed_log(
    features: DataFrame, path: str, checkpoint: str, fold_every: int = 10, buckets: int = BUCKETS
) -> StreamingQuery:
    """Write a stream of long feature rows to the log and the bucketed latest table."""
    small_splits(features.sparkSession)
    return (
        features.writeStream.foreachBatch(bucketed_sink(path, fold_every, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
