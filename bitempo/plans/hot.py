"""Splitting entities that are too large for one task.

A window over ``partitionBy(entity)`` puts all rows of an entity into one task. That is right for
the many ordinary entities and hopeless for one that holds a third of a 100 TB table. The functions
here find the few large entities and cut only those along time:

* ``hot_entities`` lists them with a chunk size and a fine bucket width that suit their size.
* ``split_rows`` serves row-frame windows (lag, lead, rolling and running statistics). It counts
  the hot rows per fine bucket, groups buckets into chunks, and copies the buckets next to a cut to
  the neighbouring chunk so that every frame is complete. What a chunk needs from before it (rows,
  moments) travels with the chunk. The data itself is shuffled once, by (entity, chunk).

Ordinary entities stay in one piece. Where no entity is large, plans are built without any of this;
otherwise every row pays for two lookups. The lists are tables written to the shared folder, one row per
hot entity and per chunk and bucket; how they are joined is left to their size. Everything is exact:
nothing is dropped, capped or sampled, and chunks keep the size asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import epoch_seconds
from ..session import stage, tasks_for

ROWS_PER_TASK = 1_000_000
BUCKETS_PER_CHUNK = 32
MOST_LISTED = 500_000
FINE_PARTS = 1 << 20  # above any number of parts a bucket is cut into


@dataclass(frozen=True)
class HotEntities:
    """The entities to split and how finely: written tables."""

    entities: DataFrame  # _entity, _entity_rows, _chunk_rows, _width (seconds per bucket)
    dense: DataFrame | None  # _dense_entity, _dense_bucket, _fine_width: buckets to cut further
    tasks: int | None = None  # for shuffles of the measured rows
    spots: int | None = None  # at most so many buckets in all


def hot_entities(
    rows: DataFrame, entity: str, time: str, rows_per_task: int = ROWS_PER_TASK
) -> HotEntities | None:
    """Entities with more than ``rows_per_task`` rows, ``None`` if there are none.

    Runs one job now: a scan of two columns with map-side aggregation. If it finds anything, a
    second one counts the hot rows per bucket, so that bursts in time are cut further. Measure once per
    stored table and pass the result on; without hot entities operators build the plain plan.
    """
    seconds = epoch_seconds(rows, time)
    n = F.col("_n")
    width = F.ceil(F.col("_span") * F.lit(rows_per_task / BUCKETS_PER_CHUNK) / n)
    listed = (
        rows.groupBy(F.col(entity).cast("string").alias("_entity"))
        .agg(F.count(F.lit(1)).alias("_n"), (F.max(seconds) - F.min(seconds)).alias("_span"))
        .filter((n > rows_per_task) & F.col("_entity").isNotNull())
        .select(
            "_entity",
            n.alias("_entity_rows"),
            F.lit(rows_per_task).cast("long").alias("_chunk_rows"),
            F.greatest(F.lit(1), F.coalesce(width, F.lit(1))).cast("long").alias("_width"),
        )
    )
    entities = stage(listed, "hot-entities")
    if entities.isEmpty():
        return None
    tasks = tasks_for(rows.sparkSession, rows.select(entity).count())
    # Even buckets, and those that bursts are cut into; a bucket holds at least one row.
    cuts = 2 * F.ceil(F.col("_entity_rows") * BUCKETS_PER_CHUNK / F.col("_chunk_rows")) + 2
    spots = entities.agg(F.sum(F.least("_entity_rows", cuts)).alias("s")).first()["s"]
    even = HotEntities(entities, None, tasks, spots)
    parts = F.ceil(n * BUCKETS_PER_CHUNK / F.col("_chunk_rows"))
    dense = stage(
        with_bucket(hot_rows(rows.select(entity, time), entity, even), entity, time, even, "inner", "_width")
        .groupBy(F.col(entity).cast("string").alias("_dense_entity"),
                 F.col("_bucket").alias("_dense_bucket"), "_chunk_rows", "_width")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter((n > F.col("_chunk_rows")) & (F.col("_width") > 1))
        .select("_dense_entity", "_dense_bucket", F.ceil(F.col("_width") / parts).cast("long").alias("_fine_width")),
        "hot-bursts",
    )
    return even if dense.isEmpty() else HotEntities(entities, dense, tasks, spots)


def resolve_hot(
    hot: HotEntities | str | None, rows: DataFrame, entity: str, time: str
) -> HotEntities | None:
    """``"auto"`` measures the input itself, a list is used as given, ``None`` switches off."""
    return hot_entities(rows, entity, time) if isinstance(hot, str) else hot


def hot_rows(rows: DataFrame, entity: str, hot: HotEntities) -> DataFrame:
    """Rows of hot entities. A semi join, because Spark moves it down to the scan."""
    return rows.join(hot.entities, F.col(entity) == F.col("_entity"), "left_semi")


def in_tasks(rows: DataFrame, hot: HotEntities, *keys: str) -> DataFrame:
    """Rows moved by ``keys`` into as many tasks as their number asks for."""
    return rows.repartition(hot.tasks, *keys) if hot.tasks else rows


def by_buckets(buckets: DataFrame, hot: HotEntities, *keys: str) -> DataFrame:
    """One row per bucket (or a few), moved by ``keys`` into as many tasks as their number asks for."""
    return buckets.repartition(tasks_for(buckets.sparkSession, hot.spots), *keys) if hot.spots else buckets


def with_bucket(
    rows: DataFrame, entity: str, time: str, hot: HotEntities, how: str, *extra: str
) -> DataFrame:
    """Add ``_chunk_rows`` and the time-ordered bucket number of each row (NULL if not hot)."""
    seconds = epoch_seconds(rows, time)
    bucket = F.floor(seconds / F.col("_width"))
    joined = rows.join(hot.entities, F.col(entity) == F.col("_entity"), how)
    columns = [F.col(c) for c in rows.columns]
    if hot.dense is not None:
        place = F.floor((seconds - bucket * F.col("_width")) / F.col("_fine_width"))
        joined = joined.join(
            hot.dense,
            (F.col(entity) == F.col("_dense_entity")) & (bucket == F.col("_dense_bucket")),
            "left",
        )
        bucket = bucket * FINE_PARTS + F.coalesce(place, F.lit(0))
    return joined.select(*columns, "_chunk_rows", *extra, bucket.cast("long").alias("_bucket"))


def _chunk_map(
    rows: DataFrame, entity: str, time: str, hot: HotEntities,
    before: int, after: int, moments_of: str | None,
) -> DataFrame:
    """Which chunks need which fine bucket: one row per (entity, bucket, chunk)."""
    v = F.col(moments_of).cast("double") if moments_of else F.lit(None).cast("double")
    counts = (
        with_bucket(hot_rows(rows, entity, hot), entity, time, hot, "inner")
        .groupBy(F.col(entity).alias("_e"), "_bucket", "_chunk_rows")
        .agg(
            F.count(F.lit(1)).alias("_cnt"), F.count(v).alias("_n"), F.avg(v).alias("_mean"),
            (F.var_pop(v) * F.count(v)).alias("_m2"),
        )
    )
    counts = by_buckets(counts, hot, "_e")
    everything = Window.partitionBy("_e")
    ordered = everything.orderBy("_bucket")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.coalesce(F.sum("_cnt").over(earlier), F.lit(0))
    # Sums are taken around the mean of the first bucket: no cancellation, and a prefix of the
    # series gives the same digits whatever follows it.
    placed = counts.select(
        "*", start.alias("_start"), F.sum("_cnt").over(everything).alias("_total"),
        F.floor(start / F.col("_chunk_rows")).alias("_chunk"),
        F.first("_mean", ignorenulls=True).over(so_far).alias("_ref"),
    )
    away = F.col("_mean") - F.col("_ref")

    def moments(frame, label: str) -> list[Column]:
        n = F.coalesce(F.sum("_n").over(frame), F.lit(0))
        s = F.coalesce(F.sum(F.col("_n") * away).over(frame), F.lit(0.0))
        q = F.coalesce(F.sum(F.col("_m2") + F.col("_n") * away * away).over(frame), F.lit(0.0))
        return [
            n.alias(f"{label}_n"),
            (F.col("_ref") + F.coalesce(F.try_divide(s, n), F.lit(0.0))).alias(f"{label}_mean"),
            (q - F.coalesce(F.try_divide(s * s, n), F.lit(0.0))).alias(f"{label}_m2"),
        ]

    in_chunk = Window.partitionBy("_e", "_chunk")
    first_of_chunk = F.min("_bucket").over(in_chunk) == F.col("_bucket")
    last_of_chunk = F.max("_bucket").over(in_chunk) == F.col("_bucket")
    # A bucket holds at least one row, so ``before`` buckets always reach far enough.
    end = F.col("_start") + F.col("_cnt")
    item = F.struct(F.col("_bucket").alias("b"), F.col("_start").alias("s"), end.alias("e"))
    empty = F.array().cast("array<struct<b:bigint,s:bigint,e:bigint>>")
    back = F.collect_list(item).over(ordered.rowsBetween(-before, -1)) if before else empty
    ahead = F.collect_list(item).over(ordered.rowsBetween(1, after)) if after else empty
    windows = placed.select(
        "_e", "_bucket", "_chunk", "_start", "_total",
        end.alias("_end"),
        F.when(first_of_chunk, back).otherwise(empty).alias("_back"),
        F.when(last_of_chunk, ahead).otherwise(empty).alias("_ahead"),
        *moments(earlier, "_carry"), *moments(everything, "_all"),
    )
    by_bucket = in_chunk.orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    chunks = windows.select(
        "*",
        *(F.first(c).over(by_bucket).alias(f"{c}_at") for c in
          ("_start", "_carry_n", "_carry_mean", "_carry_m2")),
    )
    own = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(True).alias("own")))

    def needed(c: str, condition) -> Column:
        return F.transform(
            F.filter(c, condition), lambda x: F.struct(x["b"].alias("b"), F.lit(False).alias("own"))
        )

    targets = F.concat(
        own,
        needed("_back", lambda x: x["e"] > F.col("_start") - before),
        needed("_ahead", lambda x: x["s"] < F.col("_end") + after),
    )
    return chunks.select(
        F.col("_e").alias("_map_entity"),
        F.inline(targets).alias("_map_bucket", "_map_own"),
        F.col("_chunk").alias("_map_chunk"),
        F.col("_start_at").alias("_rows_before"),
        F.col("_total").alias("_rows_total"),
        *(F.col(f"_carry_{k}_at").alias(f"_carry_{k}") for k in ("n", "mean", "m2")),
        F.col("_all_mean"),
        sample_sd(F.col("_all_n"), F.col("_all_m2")).alias("_all_sd"),
    )


CHUNK_FACTS = {
    "_rows_before": "long", "_rows_total": "long",
    "_carry_n": "long", "_carry_mean": "double", "_carry_m2": "double",
    "_all_mean": "double", "_all_sd": "double",
}


def split_rows(
    rows: DataFrame,
    entity: str,
    time: str,
    hot: HotEntities | None,
    before: int = 0,
    after: int = 0,
    moments_of: str | None = None,
) -> DataFrame:
    """Prepare ``rows`` for windows over ``(entity, _chunk)`` ordered by ``time``.

    Row frames may reach ``before`` rows back and ``after`` rows ahead. Added columns: ``_chunk``;
    ``_own`` (false for a copied neighbour row, drop those with ``own_rows``); and, NULL unless the
    entity is hot, ``_rows_before`` the chunk, ``_rows_total`` of the entity, and for the column
    ``moments_of`` count, mean and squared deviations before the chunk (``_carry_*``) and mean and
    deviation of the whole entity (``_all_*``).
    """
    if hot is None:
        return rows.select(
            "*", F.lit(0).cast("long").alias("_chunk"), F.lit(True).alias("_own"),
            *(F.lit(None).cast(t).alias(c) for c, t in CHUNK_FACTS.items()),
        )
    chunks = _chunk_map(rows, entity, time, hot, before, after, moments_of)
    bucketed = with_bucket(rows, entity, time, hot, "left")
    if hot.spots and hot.spots > MOST_LISTED:
        # Too many buckets to send to every task: both sides move, in pieces that do not grow with the table.
        bucketed = in_tasks(bucketed, hot, entity, "_bucket")
        chunks = in_tasks(chunks, hot, "_map_entity", "_map_bucket")
    placed = bucketed.join(
        chunks,
        (F.col(entity) == F.col("_map_entity")) & (F.col("_bucket") == F.col("_map_bucket")),
        "left",
    )
    pieces = placed.select(
        *(F.col(c) for c in rows.columns),
        F.coalesce("_map_chunk", F.lit(0)).alias("_chunk"),
        F.coalesce("_map_own", F.lit(True)).alias("_own"),
        *CHUNK_FACTS,
    )
    return in_tasks(pieces, hot, entity, "_chunk")


def is_split() -> Column:
    return F.col("_rows_total").isNotNull()


def running_moments(value: str, so_far) -> tuple[Column, Column, Column]:
    """Count, mean and sample deviation of ``value`` from the start of the entity to this row."""
    v = F.when(F.col("_own"), F.col(value))
    n_in = F.count(v).over(so_far)
    mean_in = F.coalesce(F.avg(v).over(so_far), F.lit(0.0))
    m2_in = F.coalesce(F.var_pop(v).over(so_far) * n_in, F.lit(0.0))
    n = n_in + F.col("_carry_n")
    gap = mean_in - F.col("_carry_mean")
    share = F.coalesce(F.try_divide(n_in.cast("double"), n), F.lit(0.0))
    m2 = F.col("_carry_m2") + m2_in + gap * gap * F.col("_carry_n") * share
    return (
        F.when(is_split(), n).otherwise(n_in),
        F.when(is_split(), F.col("_carry_mean") + gap * share).otherwise(F.avg(v).over(so_far)),
        F.when(is_split(), sample_sd(n, m2)).otherwise(F.stddev_samp(v).over(so_far)),
    )


def sample_sd(n: Column, m2: Column) -> Column:
    """Sample standard deviation from a count and a sum of squared deviations."""
    return F.when(n > 1, F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1)))


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the copied neighbour rows once the windows are evaluated."""
    return df.filter("_own")
