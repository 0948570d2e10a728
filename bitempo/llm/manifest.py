"""Merkle manifest of a dataset: a leaf per row, a tree per group, a tree over the groups.

Coordinates come from bitmaps and not from a sort. The ids of a group are a bitmap of 64-bit words of which
only nonzero ones exist (a row group, word, bits); map tasks OR their own bits, the shuffle merges those.
Directories hold the rows of every word, of every 4,096 words, and so on; running sums inside each parent
give how many rows lie before a word, and the bits below an id in its word give the rest. Ids that stand in
several rows show as words with more rows than bits: there rows are counted by leaf, and copies of one leaf
take consecutive places.

Trees are reduced ``STEP`` levels at a time: ``ARITY ** STEP`` consecutive nodes form the keyed slots of one
block, whose root is a node of the next step, so 1e12 rows take four steps. Paths go down the same blocks:
each adds its own siblings below those of its parent. A block is bounded by its slots, whatever the group.

Defined results: a null id comes before all others of its group, a null group before all others; rows with
the same group and id stand in the order of their leaves; an empty table has no leaves and no root; other
columns take no part. Ids are integers.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import small_batches, write_table

ARITY, STEP = 3, 7
FAN_BITS = 12
WORD_BITS = 6
COPIES = 4096

LEAVES = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_hash(*fields: Column) -> Column:
    """sha256 (bytes) of all fields, each ``-`` or its UTF-8 length, a colon and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
             for s in (f.cast("string") for f in fields)]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def group_key(group: Column) -> Column:
    """A key that is never null and sorts null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("v"), group.cast("string")), F.lit(""))


# ---- coordinates


def rows_before(nodes: DataFrame, span: int) -> DataFrame:
    """g, k, before: the rows of all smaller ``k`` of the group (``nodes``: g, k, n; ``span``: range of k)."""
    if span >> FAN_BITS == 0:
        within = Window.partitionBy("g").orderBy("k")
        return nodes.select("g", "k", (F.sum("n").over(within) - F.col("n")).alias("before"))
    parent = F.shiftright("k", FAN_BITS)
    above = rows_before(
        nodes.groupBy("g", parent.alias("k")).agg(F.sum("n").alias("n")), (span >> FAN_BITS) + 1
    ).select("g", F.col("k").alias("parent"), F.col("before").alias("earlier"))
    within = Window.partitionBy("g", "parent").orderBy("k")
    inside = nodes.withColumn("parent", parent).withColumn("inside", F.sum("n").over(within) - F.col("n"))
    return inside.join(above, ["g", "parent"]).select("g", "k", (F.col("earlier") + F.col("inside")).alias("before"))


def coordinates(leaves: DataFrame) -> DataFrame:
    """``leaves`` (g, id, leaf, other) with ``pos``, the place of a leaf in its group, from 0."""
    low, high = leaves.agg(F.min("id"), F.max("id")).first()
    first = (low or 0) >> WORD_BITS
    word = F.coalesce(F.shiftright("id", WORD_BITS), F.lit(first - 1).cast("long"))
    bit = F.expr("shiftleft(1L, cast(coalesce(id, 0L) & 63L as int))")
    lower = F.expr("~shiftleft(-1L, cast(coalesce(id, 0L) & 63L as int))")
    keyed = leaves.withColumn("k", word)
    words = write_table(
        keyed.groupBy("g", "k").agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n")), "id-bitmaps", "lz4")
    base = words.join(rows_before(words.select("g", "k", "n"), ((high or 0) >> WORD_BITS) - first + 2), ["g", "k"])
    placed = keyed.join(base, ["g", "k"])
    below = F.bit_count(F.col("bits").bitwiseAND(lower))
    single = placed.filter("n = bit_count(bits)").withColumn("pos", F.col("before") + below)
    single = single.select("g", "pos", "id", "leaf", "other")
    if words.filter("n > bit_count(bits)").isEmpty():
        return single
    return single.unionByName(_repeated(placed.filter("n > bit_count(bits)")))


def _repeated(placed: DataFrame) -> DataFrame:
    """Places of rows in words where ids repeat: by id, then leaf; equal rows are counted, not gathered."""
    same = placed.withColumn("id0", F.coalesce("id", F.lit(0).cast("long"))).groupBy(
        "g", "k", "before", "id", "id0", "leaf", "other").agg(F.count(F.lit(1)).alias("m"))
    same = same.withColumn("cell", F.substring(F.hex("leaf"), 1, 3))
    cells = same.groupBy("g", "k", "id0", "cell").agg(F.sum("m").alias("in_cell"))
    by_cell = Window.partitionBy("g", "k").orderBy("id0", "cell")
    cells = cells.withColumn("earlier", F.sum("in_cell").over(by_cell) - F.col("in_cell")).drop("in_cell")
    by_leaf = Window.partitionBy("g", "k", "id0", "cell").orderBy("leaf", "other")
    at = same.withColumn("inside", F.sum("m").over(by_leaf) - F.col("m")).join(cells, ["g", "k", "id0", "cell"])
    start = F.col("before") + F.col("earlier") + F.col("inside")
    spread = at.withColumn("start", start).withColumn(
        "c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / COPIES))))
    last = F.least(F.col("m"), (F.col("c") + 1) * COPIES) - 1
    return spread.withColumn("i", F.explode(F.sequence(F.col("c") * COPIES, last))).select(
        "g", (F.col("start") + F.col("i")).alias("pos"), "id", "leaf", "other")


def ranked_groups(groups: DataFrame) -> DataFrame:
    """``groups`` (g, n) with ``rank`` along g: sorted by ranges, with one count per range."""
    placed = write_table(groups.orderBy("g").withColumn("place", F.monotonically_increasing_id()), "groups")
    part = F.shiftright("place", 33)
    starts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    starts = starts.withColumn("earlier", F.sum("size").over(Window.orderBy("part")) - F.col("size"))
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select(
        "g", "n", (F.col("earlier") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("rank"))


# ---- trees


def joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(digests: list[str], levels: int) -> list[list[str]]:
    out = [digests]
    for _ in range(levels):
        out.append([joined(out[-1][i : i + ARITY]) for i in range(0, len(out[-1]), ARITY)])
    return out


def siblings(tree: list[list[str]], place: int) -> list[str]:
    """For every level the run's nodes before and after the one above ``place``: before, after, before, ..."""
    out = []
    for level in tree[:-1]:
        start = place - place % ARITY
        out += ("".join(level[start:place]), "".join(level[place + 1 : start + ARITY]))
        place //= ARITY
    return out


def fold(digest: str, path: list[str]) -> str:
    for before, after in zip(path[::2], path[1::2]):
        digest = joined([before, digest, after])
    return digest


def height(n: Column) -> Column:
    """Levels above n leaves."""
    powers = F.array(*(F.lit(ARITY**i).cast("long") for i in range(40)))
    return F.size(F.filter(powers, lambda p: p < n))


def slots_in_order(slots: list[dict]) -> list[dict]:
    return sorted(slots, key=lambda s: s["pos"])


def block_root(slots: Column, levels: Column) -> Column:
    @F.arrow_udf("binary")
    def root(slots: pa.Array, levels: pa.Array) -> pa.Array:
        return pa.array([
            bytes.fromhex(levels_of([s["leaf"].hex() for s in slots_in_order(own)], n)[-1][0])
            for own, n in zip(slots.to_pylist(), levels.to_pylist())], pa.binary())

    return root(slots, levels)


def blocks(nodes: DataFrame, step: int, *payload: str) -> DataFrame:
    """``nodes`` (g, n, pos, leaf and the payload) as blocks g, n, block, levels, slots, root."""
    grouped = nodes.groupBy("g", "n", F.floor(F.col("pos") / ARITY**STEP).cast("long").alias("block")).agg(
        F.collect_list(F.struct("pos", "leaf", *payload)).alias("slots"))
    levels = F.greatest(F.lit(0), F.least(F.lit(STEP), height(F.col("n")) - STEP * step))
    grouped = grouped.withColumn("levels", levels)
    return write_table(grouped.withColumn("root", block_root(F.col("slots"), F.col("levels"))), f"tree-{step}")


def steps_up(nodes: DataFrame, most: int, *payload: str) -> list[DataFrame]:
    """The blocks of every step; the last step has one block per group (``most``: leaves of the largest)."""
    tables = [blocks(nodes, 0, *payload)]
    while most > ARITY**STEP:
        most = -(-most // ARITY**STEP)
        below = tables[-1].select("g", "n", F.col("block").alias("pos"), F.col("root").alias("leaf"))
        tables.append(blocks(below, len(tables)))
    return tables


def slot_paths(slots: Column, levels: Column, upper: Column) -> Column:
    @F.arrow_udf("array<struct<pos long, path array<string>>>")
    def paths(slots: pa.Array, levels: pa.Array, upper: pa.Array) -> pa.Array:
        out = []
        for own, n, above in zip(slots.to_pylist(), levels.to_pylist(), upper.to_pylist()):
            own = slots_in_order(own)
            tree = levels_of([s["leaf"].hex() for s in own], n)
            out.append([{"pos": s["pos"], "path": siblings(tree, i) + above} for i, s in enumerate(own)])
        return pa.array(out, pa.list_(pa.struct([("pos", pa.int64()), ("path", pa.list_(pa.string()))])))

    return paths(slots, levels, upper)


def steps_down(tables: list[DataFrame], upper: DataFrame) -> DataFrame:
    """The blocks of the first step, each with the path above it (``upper``: g and the path above its tree)."""
    at = upper.withColumn("block", F.lit(0).cast("long"))
    for table in reversed(tables[1:]):
        below = table.join(at, ["g", "block"]).select(
            "g", F.explode(slot_paths(F.col("slots"), F.col("levels"), F.col("path"))).alias("s"))
        at = below.select("g", F.col("s.pos").alias("block"), F.col("s.path").alias("path"))
    return tables[0].join(at, ["g", "block"])


def proofs(slots: Column, levels: Column, upper: Column) -> Column:
    """Per leaf: id, leaf, the hash of all its siblings, and the root folded from its other leaf."""

    @F.arrow_udf("array<struct<id long, leaf string, proof string, folded string>>")
    def prove(slots: pa.Array, levels: pa.Array, upper: pa.Array) -> pa.Array:
        out = []
        for own, n, above in zip(slots.to_pylist(), levels.to_pylist(), upper.to_pylist()):
            own = slots_in_order(own)
            tree = levels_of([s["leaf"].hex() for s in own], n)
            rows = []
            for i, s in enumerate(own):
                path = siblings(tree, i) + above
                rows.append({"id": s["id"], "leaf": tree[0][i], "proof": joined(path), "folded": fold(s["other"].hex(), path)})
            out.append(rows)
        kind = pa.struct([("id", pa.int64()), ("leaf", pa.string()), ("proof", pa.string()), ("folded", pa.string())])
        return pa.array(out, pa.list_(kind))

    return prove(slots, levels, upper)


def manifest(leaves: DataFrame) -> DataFrame:
    """``LEAVES`` for ``leaves`` (g, id, leaf, other); ``other``: the leaf that a receiver found.

    ``folded_root`` is recomputed from ``other`` and the original siblings, ``verified`` whether it is the root.
    """
    spark = leaves.sparkSession
    small_batches(spark)
    leaves = write_table(leaves.select("g", F.col("id").cast("long").alias("id"), "leaf", "other"), "leaves")
    groups = leaves.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    groups = write_table(ranked_groups(groups), "ranked-groups")
    total, most = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    if not total:
        return spark.createDataFrame([], LEAVES)
    trees = steps_up(coordinates(leaves).join(groups.select("g", "n"), "g"), most, "id", "other")
    subroots = trees[-1].select("g", F.col("root").alias("leaf"))
    top = subroots.join(groups.select("g", F.col("rank").alias("pos")), "g").select(
        F.lit("").alias("g"), F.lit(total).cast("long").alias("n"), "pos", "leaf", F.col("g").alias("group"))
    tops = steps_up(top, total, "group")
    root = tops[-1].first().root.hex()
    start = spark.createDataFrame([("", [])], "g string, path array<string>")
    under = steps_down(tops, start)
    named = under.select(F.explode(group_paths(F.col("slots"), F.col("levels"), F.col("path"))).alias("s"))
    upper = write_table(named.select(F.col("s.group").alias("g"), F.col("s.subroot").alias("subroot"), F.col("s.path").alias("path")),
                        "group-paths")
    judged = steps_down(trees, upper.select("g", "path")).select(
        "g", F.explode(proofs(F.col("slots"), F.col("levels"), F.col("path"))).alias("s"))
    return judged.join(upper.select("g", "subroot"), "g").select(
        F.col("s.id").alias("doc_id"), F.col("s.leaf").alias("leaf"), "subroot", F.lit(root).alias("root"),
        F.col("s.proof").alias("proof_sha256"), F.col("s.folded").alias("folded_root"),
        (F.col("s.folded") == root).alias("verified"))


def group_paths(slots: Column, levels: Column, upper: Column) -> Column:
    @F.arrow_udf("array<struct<`group` string, subroot string, path array<string>>>")
    def paths(slots: pa.Array, levels: pa.Array, upper: pa.Array) -> pa.Array:
        out = []
        for own, n, above in zip(slots.to_pylist(), levels.to_pylist(), upper.to_pylist()):
            own = slots_in_order(own)
            tree = levels_of([s["leaf"].hex() for s in own], n)
            out.append([{"group": s["group"], "subroot": tree[0][i], "path": siblings(tree, i) + above}
                        for i, s in enumerate(own)])
        kind = pa.struct([("group", pa.string()), ("subroot", pa.string()), ("path", pa.list_(pa.string()))])
        return pa.array(out, pa.list_(kind))

    return paths(slots, levels, upper)


def dataset_leaves(docs: DataFrame, fields: list[str], key: str = "doc_id", group: str = "source", **received: Column) -> DataFrame:
    """Leaves of ``docs`` over ``fields``; ``received``: what a receiver found instead of a field, by name."""
    own = [docs[f] for f in fields]
    found = [received.get(f, docs[f]) for f in fields]
    return docs.select(
        group_key(docs[group]).alias("g"), docs[key].alias("id"), leaf_hash(*own).alias("leaf"),
        leaf_hash(*found).alias("other"))
