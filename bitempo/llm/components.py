"""Connected components by alternating stars: every node ends up pointing at its component's least node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import write_table


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b of one orderable type. Rows node, root for every node that is not itself a root.

    Large star: neighbours above a node move to its least neighbour. Small star: neighbours below it, and
    the node itself, do. Both only need the least neighbour of each node, a map-side aggregate, and a
    join on the node, so a node with very many neighbours is no group in one task. The number of rounds
    grows with the logarithm of the size of components.
    """
    edges = write_table(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = write_table(large.filter("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b"))
        )
        edges = write_table(small.filter("a <> b").distinct(), "small-star")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
