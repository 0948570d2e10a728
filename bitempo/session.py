"""Session settings and the shared folder for staged tables and stream checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

MIN_TASK_ROWS = 10_000
MAX_TASK_ROWS = 50_000
SPLIT_BYTES = 16 << 20
# Shuffle files of an action are deleted at its end.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "bitempo", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE with skew-join handling.

    Cluster sizing (executors, memory, shuffle partitions) is left to spark-defaults or ``conf``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session time zone; instants and zone-free timestamps then convert one to one."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder named by ``spark.checkpoint.dir``.

    Every executor must be able to reach that folder. Only where the setting is absent (unit
    tests, a laptop) a local temporary folder stands in for it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = os.path.join(tempfile.gettempdir(), "bitempo")
    return f"{root.rstrip('/')}/bitempo/{name}-{uuid.uuid4().hex}"


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for a shuffle of ``rows``: the session's number, fewer for few rows, more for very many.

    A fixed number lets the rows of a task grow with the table; this one keeps them bounded.
    """
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(usual, -(-rows // MIN_TASK_ROWS)), -(-rows // MAX_TASK_ROWS))


def small_splits(spark: SparkSession) -> None:
    """Bound what a scan of a stored log brings into one task.

    Log rows take some nine bytes, so that a split of the usual 128 MB holds 14 million; latest values sort them.
    """
    key = "spark.sql.files.maxPartitionBytes"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now > SPLIT_BYTES:
        spark.conf.set(key, SPLIT_BYTES)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by writing ``df`` to the shared folder and reading it back.

    Unlike a cached block a written table survives the loss of any executor, and being columnar
    it keeps column pruning and filter pushdown for the several passes that follow.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """As ``stage`` for frames that are all run inside the block: the folder goes with it."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    try:
        df.write.mode("overwrite").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """For actions on frames that nobody runs again: what they shuffled goes when they end.

    Otherwise it stays until the driver's collector finds it unreferenced, and several actions add up.
    """
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def write_buckets(df: DataFrame, path: str, buckets: int, keys: Sequence[str]) -> DataFrame:
    """Write ``df`` in hash buckets of ``keys``, replacing what is there, and read it back.

    Joins and groups know what is read as partitioned by ``keys`` and do not move it. Rows that are partitioned
    so already do not move for the write.
    """
    spark, name = df.sparkSession, f"buckets_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, *keys)
    placed.write.mode("overwrite").bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    rows = spark.table(name)
    # The name goes, the files stay.
    spark.sql(f"DROP TABLE {name}")
    return rows


@contextmanager
def bucket_folders(
    spark: SparkSession, path: str, columns: str, buckets: int, keys: Sequence[str], folder: str
) -> Iterator[DataFrame]:
    """All rows that ``write_buckets`` put into folders ``<folder>=<value>`` of ``path``, partitioned by ``keys``.

    ``columns`` is the schema as DDL, with the folders' column at its end. The rows can be read inside the block,
    while the catalog has a name for them.
    """
    name = f"buckets_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({folder}) "
              f"CLUSTERED BY ({', '.join(keys)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    try:
        spark.sql(f"MSCK REPAIR TABLE {name}")
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
