"""Dated store of snapshots: every pull adds what it changed, under its own date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import snapshot_baseline, vintage_diff
from ..schema import RAW_BAR_COLUMNS, RAW_BARS
from ..session import bucket_folders, exists, freed_shuffles, stage, write_buckets

KEYS = ("ticker", "date")
STORED = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_BARS.fields) + ", pull string"
MARK = "_buckets-"  # readers skip names that begin so


def read_vintages(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows, oldest pull first on disk; one scan however many pulls there were."""
    return spark.read.schema(RAW_BARS).parquet(path).select(*RAW_BAR_COLUMNS)


def add_pull(
    spark: SparkSession, path: str, snapshot: DataFrame, as_of: dt.datetime, buckets: int | None = None
) -> None:
    """Compare a normalised vendor frame with the pulls before it and write the difference.

    The first pull writes a baseline. A pull may be run again: it is compared with earlier pulls only, so it
    finds what it found before. If later pulls are stored and it finds something else (another snapshot under
    an old date), their differences would no longer hold, so it is refused and nothing is written.

    The store is begun in ``buckets`` of (ticker, date), the session's number of shuffle tasks by default. A pull
    moves its snapshot there, unless that is partitioned so, and its difference; what is stored stays in place.
    """
    buckets = stored_buckets(spark, path) if exists(spark, path) else begin(spark, path, buckets)
    with freed_shuffles(spark):
        if buckets is None:
            plain = spark.read.schema(STORED).option("basePath", path).parquet(path)
            _add(path, plain, snapshot, as_of, None)
            return
        with bucket_folders(spark, path, STORED, buckets, KEYS, "pull") as stored:
            _add(path, stored, snapshot, as_of, buckets)


def _add(path: str, stored: DataFrame, snapshot: DataFrame, as_of: dt.datetime, buckets: int | None) -> None:
    pull = f"{as_of:%Y-%m-%dT%H-%M-%S}"
    at = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    pulls = {r.pull for r in stored.select("pull").distinct().collect()}
    if buckets is not None:
        snapshot = snapshot.repartition(buckets, *KEYS)
    # Names of pulls sort like their times.
    if min(pulls | {pull}) == pull:
        added = snapshot_baseline(snapshot)
    else:
        earlier = stored.filter(F.col("pull") < pull)
        added = vintage_diff(earlier.select(*RAW_BAR_COLUMNS), snapshot, at)
    added = added.select(*RAW_BAR_COLUMNS)
    place = f"{path}/pull={pull}"
    if pull not in pulls and max(pulls | {pull}) == pull:
        # Nothing is replaced and nothing builds on it yet.
        _write(added, place, buckets)
        return
    before = stored.filter(F.col("pull") == pull).select(*RAW_BAR_COLUMNS)
    if stage(unequal_rows(added, before, buckets), "pull-differs").isEmpty():
        return
    if any(p > pull for p in pulls):
        raise ValueError(f"pull {pull} differs from what is stored, and later pulls build on that")
    # The difference is settled before its own folder is touched, and that only if it holds something else.
    _write(stage(added, "pull"), place, buckets)


def _write(added: DataFrame, place: str, buckets: int | None) -> None:
    if buckets is None:
        added.write.mode("overwrite").parquet(place)
    else:
        write_buckets(added, place, buckets, KEYS)


def begin(spark: SparkSession, path: str, buckets: int | None) -> int:
    """Mark an empty store with its number of buckets."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MARK}{buckets}")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark).close()
    return buckets


def stored_buckets(spark: SparkSession, path: str) -> int | None:
    """The number a store was begun with, ``None`` if it is older than buckets: it then goes on without."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [e.getPath().getName() for e in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
    return next((int(n.removeprefix(MARK)) for n in names if n.startswith(MARK)), None)


def unequal_rows(left: DataFrame, right: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows that one side holds more often than the other, and by how much, in one aggregation.

    ``right`` stays in place if it is kept in ``buckets``, and ``left`` if it is partitioned so: each side has
    the key once, under another name than its scan's, and outside the row nothing that equals it.
    """
    row = F.struct(*(c for c in left.columns if c not in KEYS)).alias("_row")
    keys = [f"_{k}" for k in KEYS]

    def sided(rows: DataFrame, more: int) -> DataFrame:
        return rows.select(*(F.col(k).alias(n) for k, n in zip(KEYS, keys)), row, F.lit(more).alias("_more"))

    own = sided(left, 1) if buckets is None else sided(left, 1).repartition(buckets, *keys)
    both = own.unionByName(sided(right, -1))
    return both.groupBy(*keys, "_row").agg(F.sum("_more").alias("_more")).filter("_more != 0")
