"""Exact n-gram Jaccard join with signature trees, and the components of its links.

1. Every text becomes its set of five-word shingles (64-bit hashes) and an exact digest of the set; texts with
   the same set are one class. The same pass counts shingles in ``CELLS`` hash cells.
2. Two sets that reach the threshold share one of each other's rarest shingles: of n, the n - ceil(t n) + 1
   first in any common order. The order is by the count of a shingle's cell, rare ones first, so passages that
   many documents share bring hardly any together. This is exact, whatever the counts say.
3. The classes that share such a shingle are a bucket; buckets of the same classes count once. Each builds a
   signature tree over folded bitmaps (about four bits a shingle): leaves are classes ordered by size, a node
   holds the OR of its children's bitmaps and their least and greatest size. A dual traversal descends into
   pairs of nodes whose greatest possible overlap reaches the threshold; pairs of classes that arrive may be
   links, and those that join something not joined yet leave the task. Whatever they connect is a unit. Every
   link lies in one unit, and a class ships its whole set once. (Buckets beyond ``BLOCK`` classes go into one
   unit as they are.)
4. Units beyond ``BLOCK`` classes or ``BLOCK_TOKENS`` shingles are cut into blocks, classes with the same most
   shared shingle together. Each block builds the tree again, now over the shingles that it has more than once,
   and pairs that arrive are verified on the full sets. Only links between classes that are not linked yet
   leave the task, so a block gives fewer links than it has classes.
5. Units of several blocks: classes outside the unit's main component so far, in chunks, meet all its blocks of
   similar sizes, again through a tree and again only for links that join something. Work is quadratic only in
   blocks, and only for classes of one unit that are in truth not linked with its main part.

The shingles that folding hides in a bitmap are counted as possible overlap, so it never loses a link.

Defined results: null and wordless texts have an empty set and link with nothing; fewer than five words are
one shingle; rows that repeat an id are separate rows with the component of their own text; null ids count as
an id above all others; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .text import WordHashes, gram_hashes, lower_space_words, small_batches, utf8, write_table

WORDS, PERCENT = 5, 80
CELL_BITS = 18
CELLS = 1 << CELL_BITS
BLOCK, BLOCK_TOKENS = 2048, 4 << 20
WIDTH, FAN = 1 << 15, 8
KNOWN_WORDS = 200_000
SIZE_BAND = 1.25
SIGNATURE_BITS = (6, 15)


class Shingler:
    def __init__(self, words: int):
        self.words, self.hashes = words, WordHashes(KNOWN_WORDS)

    def __call__(self, raw: bytes | None) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        own = lower_space_words(raw)
        if not own:
            return np.zeros(0, np.uint64)
        return np.unique(gram_hashes(self.hashes(own), min(self.words, len(own))))


def digest_of(tokens: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


def cell_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def described(base: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Rows id, n, digest of all texts (``base``: id, raw), and rows cell, times."""
    kind = base.schema["id"].dataType.simpleString()
    id_type = base.select("id").limit(0).toArrow().schema.field("id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, total = Shingler(words), np.zeros(CELLS, np.int64)
        for b in batches:
            sets = [shingle(t) for t in b.column(1).to_pylist()]
            total += np.bincount(cell_of(np.concatenate([np.zeros(0, np.uint64), *sets])), minlength=CELLS)
            nothing = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([digest_of(s) for s in sets], pa.binary()), nothing, nothing], names=names)
        some = np.flatnonzero(total)
        nothing = [pa.nulls(len(some), t) for t in (id_type, pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array(some), pa.array(total[some])], names=names)

    names = ["id", "n", "digest", "cell", "times"]
    both = write_table(base.mapInArrow(run, f"id {kind}, n long, digest binary, cell long, times long"), "sets", "lz4")
    return both.filter("n is not null").select("id", "n", "digest"), both.filter("cell is not null").select("cell", "times")


def cell_classes(cells: DataFrame) -> np.ndarray:
    """A rank for every cell: eight steps for each doubling of its count."""
    times = np.zeros(CELLS, np.int64)
    for r in cells.groupBy("cell").agg(F.sum("times").alias("times")).collect():
        times[r.cell] = r.times
    return np.floor(8 * np.log2(1 + times)).astype(np.uint16)


def rarest(tokens: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """Those shingles of which a set that reaches the threshold has one among its own."""
    n = len(tokens)
    if not n:
        return tokens
    return tokens[np.lexsort((tokens, ranks[cell_of(tokens)]))[: n - -(-percent * n // 100) + 1]]


def signature(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of about four bits a shingle, in bytes; any smaller power of two is a fold of it."""
    width = 1 << int(np.clip(np.ceil(np.log2(4 * len(tokens))), *SIGNATURE_BITS))
    bits = np.zeros(width, bool)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def prefixes(base: DataFrame, ranks: np.ndarray, percent: int, words: int) -> DataFrame:
    """digest, n, signature and the rarest shingles of every nonempty text."""
    shared = base.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for b in batches:
            sets = [s for s in map(shingle, b.column(0).to_pylist()) if len(s)]
            few = [rarest(s, shared.value, percent).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array(few, pa.list_(pa.int64()))],
                names=["digest", "n", "signature", "tokens"])

    kind = "digest binary, n long, signature binary, tokens array<long>"
    return write_table(base.select("raw").mapInArrow(run, kind), "prefixes", "lz4")


# ---- the tree


def common_bits(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), np.int64)
    step = max(1, (1 << 21) // max(1, bits.shape[1]))
    for i in range(0, len(a), step):
        own = slice(i, i + step)
        out[own] = np.bitwise_count(bits[a[own]] & bits[b[own]]).sum(axis=1, dtype=np.int64)
    return out


class Level:
    """Nodes: OR of bitmaps, least and greatest size, most shingles hidden by folding, label if all share it."""

    def __init__(self, bits, least, most, hidden, label):
        self.bits, self.least, self.most, self.hidden, self.label = bits, least, most, hidden, label

    def __len__(self):
        return len(self.least)

    def parents(self) -> Level:
        at = np.arange(0, len(self), FAN)
        low, high = np.minimum.reduceat(self.label, at), np.maximum.reduceat(self.label, at)
        return Level(
            np.bitwise_or.reduceat(self.bits, at, axis=0), np.minimum.reduceat(self.least, at),
            np.maximum.reduceat(self.most, at), np.maximum.reduceat(self.hidden, at), np.where(low == high, low, -1))

    def promising(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes may hold a link between different labels."""
        fine = (100 * self.most[a] >= percent * self.least[b]) & (100 * self.most[b] >= percent * self.least[a])
        fine &= (self.label[a] != self.label[b]) | (self.label[a] < 0)
        at = np.flatnonzero(fine)
        x, y = a[at], b[at]
        overlap = common_bits(self.bits, x, y) + np.minimum(self.hidden[x], self.hidden[y])
        overlap = np.minimum(overlap, np.minimum(self.most[x], self.most[y]))
        return at[(100 + percent) * overlap >= percent * (self.least[x] + self.least[y])]


def leaves(sets: list[np.ndarray], label: np.ndarray) -> Level:
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    some = shared[token]
    token, owner = number[token[some]], owner[some]
    width = max(64, min(int(shared.sum()), WIDTH))
    place = token % width
    bits = np.zeros((len(sets), -(-width // 64)), np.uint64)
    np.bitwise_or.at(bits, (owner, place >> 6), np.left_shift(np.uint64(1), (place & 63).astype(np.uint64)))
    hidden = np.bincount(owner, minlength=len(sets)) - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    return Level(bits, sizes, sizes, hidden, label)


def offspring(a: np.ndarray, b: np.ndarray, size: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children of node pairs, first not after second (``same``: a child may meet itself)."""
    step = np.arange(FAN)
    x = np.repeat(a[:, None] * FAN + step, FAN, axis=1)
    y = np.tile(b[:, None] * FAN + step, (1, FAN))
    keep = (x < size) & (y < size) & ((x <= y) if same else (x < y))
    return x[keep], y[keep]


def tree_links(sets: list[np.ndarray], label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different labels that suffice to join all that are linked."""
    if len(sets) < 2:
        return []
    order = np.lexsort((label, [len(s) for s in sets]))
    own = [sets[i] for i in order]

    def similar(p: int, q: int) -> bool:
        k = len(np.intersect1d(own[p], own[q], assume_unique=True))
        return (100 + percent) * k >= percent * (len(own[p]) + len(own[q]))

    return [(int(order[p]), int(order[q])) for p, q in traverse(leaves(own, label[order]), percent, similar)]


def traverse(bottom: Level, percent: int, similar=None) -> Iterator[tuple[int, int]]:
    """Pairs of leaves that may be (``similar``: are) links and join what no pair before them joined."""
    label = bottom.label.copy()
    levels = [bottom]
    while len(levels[-1]) > FAN:
        levels.append(levels[-1].parents())
    a, b = np.triu_indices(len(levels[-1]), k=0 if len(levels) > 1 else 1)
    for depth in range(len(levels) - 1, 0, -1):
        at = levels[depth].promising(a, b, percent)
        a, b = a[at], b[at]
        if depth > 1:
            a, b = offspring(a, b, len(levels[depth - 1]), True)
    near = np.argsort(b - a, kind="stable")
    a, b = a[near], b[near]
    for i in range(0, len(a), 1024):
        x, y = (a[i : i + 1024], b[i : i + 1024])
        if len(levels) > 1:
            x, y = offspring(x, y, len(bottom), False)
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
        at = bottom.promising(x, y, percent)
        for p, q in zip(x[at], y[at]):
            if label[p] != label[q] and (similar is None or similar(p, q)):
                label[label == label[q]] = label[p]
                yield p, q


def possible_links(rows: list[dict], percent: int) -> list[tuple[int, int]]:
    """Pairs of classes (n, signature) that connect all whose signatures allow a link."""
    n = np.array([r["n"] for r in rows])
    band = np.floor(np.log(n) / np.log(SIZE_BAND)).astype(np.int64)
    label = np.arange(len(rows))
    out = []
    for low in np.unique(band):
        # Sizes of a link are at most one band apart.
        own = np.flatnonzero((band == low) | (band == low + 1))
        own = own[np.argsort(n[own], kind="stable")]
        if len(own) < 2:
            continue
        raw = [np.frombuffer(rows[i]["signature"], np.uint64) for i in own]
        width = min(map(len, raw))
        bits = np.stack([np.bitwise_or.reduce(x.reshape(-1, width), axis=0) for x in raw])
        hidden = n[own] - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        for p, q in traverse(Level(bits, n[own], n[own], hidden, label[own]), percent):
            out.append((int(own[p]), int(own[q])))
            label[label == label[own[q]]] = label[own[p]]
    return out


def bucket_links(slots: Column, percent: int) -> Column:
    @F.arrow_udf("array<struct<a binary, b binary>>")
    def links(blocks: pa.Array) -> pa.Array:
        out = []
        for rows in blocks.to_pylist():
            out.append([{"a": rows[x]["digest"], "b": rows[y]["digest"]} for x, y in possible_links(rows, percent)])
        return pa.array(out, _EDGES)

    return links(slots)


def as_sets(rows: list[dict]) -> list[np.ndarray]:
    return [np.frombuffer(r["tokens"], np.uint64) for r in rows]


def links_within(slots: Column, percent: int) -> Column:
    @F.arrow_udf("array<struct<a binary, b binary>>")
    def links(blocks: pa.Array) -> pa.Array:
        out = []
        for i in range(len(blocks)):
            rows = blocks[i].as_py()
            pairs = tree_links(as_sets(rows), np.arange(len(rows)), percent)
            out.append([{"a": rows[x]["digest"], "b": rows[y]["digest"]} for x, y in pairs])
        return pa.array(out, _EDGES)

    return links(slots)


def links_across(asking: Column, slots: Column, percent: int) -> Column:
    @F.arrow_udf("array<struct<a binary, b binary>>")
    def links(asking: pa.Array, blocks: pa.Array) -> pa.Array:
        out = []
        for i in range(len(blocks)):
            rows = {r["digest"]: r for r in asking[i].as_py() + blocks[i].as_py()}
            rows = list(rows.values())
            number: dict[bytes, int] = {}
            label = np.array([number.setdefault(r["root"], len(number)) for r in rows])
            pairs = tree_links(as_sets(rows), label, percent)
            out.append([{"a": rows[x]["digest"], "b": rows[y]["digest"]} for x, y in pairs])
        return pa.array(out, _EDGES)

    return links(asking, slots)


_EDGES = pa.list_(pa.struct([("a", pa.binary()), ("b", pa.binary())]))


# ---- the jobs


def with_root(classes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``classes`` with the least digest of their component in column ``name``."""
    roots = components(edges).select(F.col("node").alias("digest"), F.col("root").alias(name))
    return classes.join(roots, "digest", "left").withColumn(name, F.coalesce(name, "digest"))


def parts_needed(classes: Column, tokens: Column) -> Column:
    return F.greatest(F.ceil(classes / BLOCK), F.ceil(tokens / BLOCK_TOKENS), F.lit(1)).cast("int")


def in_blocks(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """``candidates`` (digest, n, unit) with their block: (unit, part, piece)."""
    often = members.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    hub = members.join(often, "token").groupBy("digest").agg(F.max(F.struct("often", "token")).alias("hub"))
    size = candidates.groupBy("unit").agg(parts_needed(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    placed = candidates.join(size, "unit").join(hub, "digest").withColumn(
        "part", F.pmod(F.xxhash64("hub.token"), F.col("parts")))
    pieces = placed.groupBy("unit", "part").agg(parts_needed(F.count(F.lit(1)), F.sum("n")).alias("pieces"))
    return placed.join(pieces, ["unit", "part"]).withColumn(
        "piece", F.pmod(F.xxhash64("digest"), F.col("pieces"))).select("digest", "n", "unit", "part", "piece")


def texts_of(base: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """``classes`` (with digest and first, an id that has it) with their full sets."""

    @F.arrow_udf("binary")
    def full(raw: pa.Array, digest: pa.Array) -> pa.Array:
        shingle = Shingler(words)
        sets = ((shingle(t), d) for t, d in zip(raw.to_pylist(), digest.to_pylist()))
        # An id may stand for several texts, of which only one belongs.
        return pa.array([s.tobytes() if digest_of(s) == d else None for s, d in sets], pa.binary())

    # With an argument of each side the sets are made after the join, of candidates alone.
    found = base.join(classes, base["id"].eqNullSafe(classes["first"])).withColumn("tokens", full(F.col("raw"), F.col("digest")))
    return found.filter("tokens is not null").drop("id", "raw", "first").dropDuplicates(["digest"])


def distinct_buckets(members: DataFrame) -> DataFrame:
    """``members`` (token, digest) with the size of their bucket; of buckets with the same classes one is kept."""
    one, two = F.xxhash64("digest"), F.xxhash64("digest", F.lit(1))
    buckets = members.groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(one).alias("one"), F.bit_xor(two).alias("two"))
    buckets = buckets.groupBy("size", "one", "two").agg(F.min("token").alias("token")).select("token", "size")
    return write_table(members.join(buckets, "token"), "buckets", "lz4")


def meetings(members: DataFrame, few: DataFrame, percent: int) -> DataFrame:
    """Edges a, b that connect all classes of ``members`` (token, digest) that may be linked.

    ``few``: digest, n and signature of all texts.
    """
    kept = distinct_buckets(members)
    known = few.select("digest", "n", "signature").join(kept.select("digest").distinct(), "digest", "left_semi")
    small = kept.filter(F.col("size") <= BLOCK).join(known.dropDuplicates(["digest"]), "digest").groupBy("token").agg(
        F.collect_list(F.struct("digest", "n", "signature")).alias("slots"))
    edges = small.select(F.explode(bucket_links(F.col("slots"), percent)).alias("e")).select("e.*")
    return edges.unionAll(stars(kept)).distinct()


def stars(kept: DataFrame) -> DataFrame:
    """Edges a, b that connect each bucket of more than ``BLOCK`` classes whole."""
    large = kept.filter(F.col("size") > BLOCK)
    pivots = large.groupBy("token").agg(F.min("digest").alias("b"))
    return large.join(pivots, "token").select(F.col("digest").alias("a"), "b")


def linked(
    base: DataFrame, classes: DataFrame, members: DataFrame, meets: DataFrame, percent: int, words: int,
    within=links_within, across=links_across,
) -> DataFrame:
    """Edges a, b (digests) that connect exactly what the links connect.

    ``members``: token, digest; ``meets``: edges a, b that connect all classes that may be linked. ``within``
    and ``across`` make the columns of links of a block, and of a chunk against a block.
    """
    meets = write_table(meets, "meetings", "lz4")
    candidates = meets.select(F.explode(F.array("a", "b")).alias("digest")).distinct().join(classes, "digest")
    candidates = write_table(with_root(candidates, meets, "unit"), "units", "lz4")
    placed = in_blocks(candidates.select("digest", "n", "unit"), members).join(candidates.select("digest", "first"), "digest")
    sets = write_table(texts_of(base, placed, words), "full-sets", "lz4")
    block = ["unit", "part", "piece"]
    grouped = sets.groupBy(*block).agg(F.collect_list(F.struct("digest", "tokens")).alias("slots"))
    links = write_table(
        grouped.select(F.explode(within(F.col("slots"), percent)).alias("e")).select("e.*"), "links", "lz4")

    large = sets.select(*block).distinct().groupBy("unit").agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1")
    if large.isEmpty():
        return links
    rooted = with_root(sets.join(large.select("unit"), "unit"), links, "root")
    rooted = write_table(rooted, "rooted-sets", "lz4")
    main = rooted.groupBy("unit", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("unit").agg(
        F.max(F.struct("k", "root")).alias("m")).select("unit", F.col("m.root").alias("main"))
    open_ = rooted.join(main, "unit").filter("root <> main")
    band = F.floor(F.log(F.col("n")) / float(np.log(SIZE_BAND)))
    open_ = open_.withColumn("band", band)
    chunks = open_.groupBy("unit", "band").agg(parts_needed(F.count(F.lit(1)), F.sum("n")).alias("chunks"))
    slots = F.collect_list(F.struct("digest", "root", "tokens"))
    asking = open_.join(chunks, ["unit", "band"]).groupBy(
        "unit", "band", F.pmod(F.xxhash64("digest", F.lit(1)), F.col("chunks")).alias("chunk")
    ).agg(F.min("n").alias("low"), F.max("n").alias("high"), slots.alias("asking"))
    against = rooted.groupBy(*block).agg(F.min("n").alias("least"), F.max("n").alias("most"), slots.alias("slots"))
    tiles = asking.join(against, "unit").filter(
        (100 * F.col("high") >= percent * F.col("least")) & (100 * F.col("most") >= percent * F.col("low")))
    more = tiles.select(F.explode(across(F.col("asking"), F.col("slots"), percent)).alias("e")).select("e.*")
    return links.unionAll(write_table(more, "more-links", "lz4"))


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS
) -> DataFrame:
    """Rows id, n_shingles, component_id for all of ``docs``."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(key).alias("id"), utf8(F.col(text)).alias("raw"))
    sets, cells = described(base, words)
    few = prefixes(base, cell_classes(cells), percent, words)
    # Least and greatest class of a shingle differ where several have it.
    spread = few.select(F.xxhash64("digest").alias("d"), F.explode("tokens").alias("token"))
    shared = spread.groupBy("token").agg(F.min("d").alias("low"), F.max("d").alias("high")).filter("low < high")
    members = few.select("digest", F.explode("tokens").alias("token")).join(shared.select("token"), "token")
    members = write_table(members.distinct(), "shared-shingles", "lz4")
    classes = sets.filter("n > 0").groupBy("digest", "n").agg(F.min("id").alias("first"))
    classes = write_table(classes, "classes", "lz4")
    edges = linked(base, classes, members, meetings(members, few, percent), percent, words)
    rooted = with_root(classes, edges, "root")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("digest", "root").join(ids, "root").select("digest", "component_id")
    return sets.select("id", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left").select(
        "id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
