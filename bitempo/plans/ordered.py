"""Exact order statistics without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage

# Widths in microseconds: a day, a second, a microsecond. Each step splits one bucket of the step
# before into at most 86,400 or 1,000,000 parts, so no step ever holds more groups than that
# (the first one holds one group per calendar day).
STEPS = (86_400_000_000, 1_000_000, 1)


def time_quantile(df: DataFrame, time: str, fraction: float) -> DataFrame:
    """Exact, linearly interpolated quantile of a zone-free timestamp: one row ``cut, n``.

    Finds the two neighbouring order statistics by narrowing a histogram. Every step is a
    map-side aggregate over at most two buckets, so no task ever sees the sorted column.
    """
    # Repeated times collapse once; the steps share that aggregate.
    values = (
        df.filter(F.col(time).isNotNull())
        .groupBy(F.unix_micros(F.col(time).cast("timestamp")).alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    everything = Window.partitionBy("which")
    upto = everything.orderBy("b")
    targets = None
    for width in STEPS:
        bucket = F.expr(f"v div {width}") if width > 1 else F.col("v")
        floor = bucket - F.when((F.col("v") % width) < 0, 1).otherwise(0)
        part = values.withColumn("b", floor)
        if targets is None:
            # Both order statistics start from the same histogram of days.
            counts = part.groupBy("b").agg(F.sum("c").alias("c")).select(
                "b", "c", F.explode(F.array(F.lit("low"), F.lit("high"))).alias("which")
            )
            n = F.sum("c").over(everything)
            place = F.lit(fraction) * (n - 1)
            counts = counts.withColumn("n", n).withColumn(
                "rank", F.when(F.col("which") == "low", F.floor(place)).otherwise(F.ceil(place))
            )
        else:
            parent = F.floor(F.col("b") * width / previous).cast("long")
            inside = part.withColumn("parent", parent)
            counts = (
                inside.join(F.broadcast(targets), "parent")
                .groupBy("which", "b", "n", "rank")
                .agg(F.sum("c").alias("c"))
            )
        passed = F.sum("c").over(upto) - F.col("c")
        hit = counts.withColumn("passed", passed).filter(
            (F.col("passed") <= F.col("rank")) & (F.col("rank") < F.col("passed") + F.col("c"))
        )
        targets = hit.select(
            "which", F.col("b").alias("parent"), "n", (F.col("rank") - F.col("passed")).alias("rank")
        )
        previous = width
    place = F.lit(fraction) * (F.max("n") - 1)
    low = F.max(F.when(F.col("which") == "low", F.col("parent")))
    high = F.max(F.when(F.col("which") == "high", F.col("parent")))
    micros = low + F.round((high - low) * (place - F.floor(place))).cast("long")
    return targets.agg(
        F.timestamp_micros(micros).cast("timestamp_ntz").alias("cut"), F.max("n").alias("n")
    )


def rank_area(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve, ties averaged: one row ``n, area``.

    The area is the share of (positive, negative) pairs in the right order, ties counting half. Rows with one
    score collapse to two counts first (map-side), however many they are. The scores are then cut into ranges;
    what lies below a range is a running sum over one total per range, and each range is summed alone. Counts
    are whole numbers until the last division. Rows without score or label (0 or 1) are left out; NaN is
    the greatest score; ``area`` is NULL without rows of both labels.
    """
    positive, negative = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    rows = scored.select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y"))
    counts = rows.filter(F.col("s").isNotNull() & F.col("y").isin(0.0, 1.0)).groupBy("s").agg(
        positive.alias("pos"), negative.alias("neg"))
    # Written, so that the totals and the sums see the same ranges.
    ranges = stage(counts.repartitionByRange("s").withColumn("part", F.spark_partition_id()), "score-ranges")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    below = ranges.groupBy("part").agg(F.sum("neg").alias("all")).select(
        "part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("below"))
    upto = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranges.select("part", "pos", "neg", (F.sum("neg").over(upto) - F.col("neg")).alias("inside"))
    whole = "decimal(19,0)"
    won = F.col("pos").cast(whole) * (2 * (F.col("below") + F.col("inside")) + F.col("neg")).cast(whole)
    totals = placed.join(below, "part").agg(
        F.sum(won).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    pairs = 2.0 * F.col("p").cast("double") * F.col("q")
    return totals.select(
        F.coalesce(F.col("p") + F.col("q"), F.lit(0)).alias("n"),
        F.try_divide(F.col("won").cast("double"), pairs).alias("area"))
