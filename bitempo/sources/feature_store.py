"""A feature table laid out for as-of reads: bucketed by entity, sorted by knowledge time.

A read then shuffles its requests only, into the buckets of the store; the store's rows stay where they
are stored and pass by the requests of their bucket. Worth it where one store serves many reads.

An entity with more rows than a task should take must not fill one bucket. Such entities are found when the
store is written and kept in a second, range-partitioned table; requests for them, and for
entities that are asked for more often than that, take the ordinary read, which is cut along time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pit import pit_join
from ..plans.hot import MOST_LISTED, ROWS_PER_TASK, HotEntities, hot_entities
from ..schema import FEATURE_NAMES
from ..session import freed_shuffles, stage, staged, tasks_for

ORDINARY, LARGE = "ordinary", "large"


@dataclass(frozen=True)
class FeatureStore:
    table: str  # catalog name of the bucketed part
    buckets: int
    ordinary: DataFrame
    large: DataFrame | None  # rows of large entities
    rows_per_task: int


def _listed(entities: DataFrame) -> DataFrame:
    """Names of entities. They are sent to every task, so that what they are looked up for stays, unless very many."""
    names = entities.select("_entity")
    return F.broadcast(names) if names.count() <= MOST_LISTED else names


def _named(rows: DataFrame, names: DataFrame, how: str = "left_semi") -> DataFrame:
    return rows.join(names, F.col("entity_id") == F.col("_entity"), how)


def write_store(
    features: DataFrame, path: str, table: str, buckets: int, rows_per_task: int = ROWS_PER_TASK
) -> FeatureStore:
    """Write a long or wide feature table to ``path`` and register its bucketed part as ``table``.

    Rows without an entity or a knowledge time answer no read and are not stored. One file per bucket: the rows
    are moved to their bucket before they are written.
    """
    times = F.col("entity_id").isNotNull() & F.col("knowledge_timestamp").isNotNull()
    spark, large = features.sparkSession, None
    # Written first: counting, ranging and both writes pass over the rows. Nobody needs them afterwards.
    with freed_shuffles(spark), staged(features.filter(times), "store-rows") as rows:
        hot = hot_entities(rows, "entity_id", "knowledge_timestamp", rows_per_task)
        ordinary = rows
        if hot is not None:
            names = _listed(hot.entities)
            apart = _named(rows, names).repartitionByRange("entity_id", "knowledge_timestamp")
            apart.write.mode("overwrite").parquet(f"{path}/{LARGE}")
            large = spark.read.schema(features.schema).parquet(f"{path}/{LARGE}")
            ordinary = _named(rows, names, "left_anti")
        (
            ordinary.repartition(buckets, "entity_id")
            .write.mode("overwrite")
            .bucketBy(buckets, "entity_id")
            .sortBy("entity_id", "knowledge_timestamp")
            .option("path", f"{path}/{ORDINARY}")
            .saveAsTable(table)
        )
    return FeatureStore(table, buckets, spark.table(table), large, rows_per_task)


def stored_join(spine: DataFrame, store: FeatureStore, order: str = "event", **options) -> DataFrame:
    """``pit_join`` against a stored table: the same rows, without moving the ordinary part of the store.

    ``options`` go to ``pit_join`` (features, keep).
    """
    spine = spine.filter(F.col("entity_id").isNotNull() & F.col("request_time").isNotNull())
    busy = hot_entities(spine, "entity_id", "request_time", store.rows_per_task)
    apart = [] if busy is None else [busy.entities.select("_entity")]
    if store.large is not None:
        apart.append(store.large.select(F.col("entity_id").alias("_entity")).distinct())
    if not apart:
        return _in_buckets(spine, store, order, options)
    both = apart[0] if len(apart) == 1 else apart[0].union(apart[1]).distinct()
    names = _listed(stage(both, "store-apart"))
    # All that is kept apart is named; of the ordinary part, what is asked for too often.
    facts = [] if store.large is None else [store.large]
    if busy is not None:
        facts.append(_named(store.ordinary, _listed(busy.entities)))
    facts = facts[0] if len(facts) == 1 else facts[0].unionByName(facts[1])
    split = _split_read(_named(spine, names), facts, order, options)
    return _in_buckets(_named(spine, names, "left_anti"), store, order, options).unionByName(split)


def _split_read(spine: DataFrame, facts: DataFrame, order: str, options: dict) -> DataFrame:
    """The ordinary read of what no bucket holds, cut along time where an entity is too large for a task.

    Elsewhere both sides move once, by entity; long rows gather and are read where they arrive.
    """
    times = facts.select("entity_id", F.col("knowledge_timestamp").alias("_t"))
    hot = hot_entities(times.union(spine.select("entity_id", "request_time")), "entity_id", "_t")
    if hot is not None:
        return pit_join(spine, facts, order=order, hot=hot, gather=True, **options)
    versions = len(options.get("features", FEATURE_NAMES)) if "feature_name" in facts.columns else 1
    tasks = tasks_for(facts.sparkSession, -(-facts.count() // versions))
    asked, known = (
        side.withColumnRenamed("entity_id", "_entity_key").repartition(tasks, "_entity_key") for side in (spine, facts))
    read = pit_join(asked, known, order=order, hot=None, entity="_entity_key", gather=True, **options)
    return read.withColumnRenamed("_entity_key", "entity_id")


def _in_buckets(spine: DataFrame, store: FeatureStore, order: str, options: dict) -> DataFrame:
    # As many partitions as buckets and by the same hash, so the union of both is partitioned already. That is
    # seen only where each side has the key once: under its inner name until the end.
    asked = spine.withColumnRenamed("entity_id", "_entity_key").repartition(store.buckets, "_entity_key")
    read = pit_join(asked, store.ordinary, order=order, hot=None, entity="_entity_key", gather=True, **options)
    return read.withColumnRenamed("_entity_key", "entity_id")


def open_store(
    spark: SparkSession, path: str, table: str, buckets: int, columns: str, large: bool, rows_per_task: int = ROWS_PER_TASK
) -> FeatureStore:
    """A written store in a session whose catalog does not know it; ``columns`` is its schema as DDL."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet LOCATION '{path}/{ORDINARY}' "
        f"CLUSTERED BY (entity_id) SORTED BY (entity_id, knowledge_timestamp) INTO {buckets} BUCKETS"
    )
    apart = spark.read.schema(columns).parquet(f"{path}/{LARGE}") if large else None
    return FeatureStore(table, buckets, spark.table(table), apart, rows_per_task)
