"""Ranked lexical search with bit-sliced signatures.

Index: documents in blocks; each document is a Bloom signature of its terms, and a block holds the signatures
sliced: bit j of all its documents is one bitmap over documents. Documents of a block have similar numbers of
terms, and the signature is as wide as its largest document needs. A term that occurs ``LEVELS[i]`` times or
more is entered once more under that level, so that presence also bounds its count.

Search: the slices of a query term, combined by AND, are the documents that may hold it; the others cannot.
Weighted sums of those bitmaps, level by level, bound every document's score from above in whole numbers.
The documents of the highest bounds are scored exactly on their texts; the k-th best of them is a limit that
every document of the result reaches, so the second sweep over the slices excludes all that stay below it (or
reach it just with a greater id) and scores the rest exactly. Nothing is sampled or cut: the result is exact.

The items are a stated query set and are searched in blocks of about ``ITEM_BYTES`` of text, each broadcast on
its own and written out before the next, so a large set costs more passes and not more memory.

Defined results: null and wordless texts are no documents of the statistics and never a result; an item
without words gives no row; rows that repeat an id are each ranked; null ids rank after all others among equal
scores; rows that repeat an item (and null item ids) are each answered; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import alnum_words, mix, small_batches, utf8, write_table

TOP = 10
SEEDS = 20
ITEM_BYTES = 1 << 19
BLOCK_DOCUMENTS = 1024
LEVELS = (1, 2, 3, 5, 9)
BITS_PER_KEY = 12
HASHES = 3
BLOCK_BITS = 1 << 25
LAST_ID = (1 << 63) - 1
_SALTS = mix(np.arange(1, HASHES + 1, dtype=np.uint64))
_LEVEL_SALTS = mix(np.arange(101, 101 + len(LEVELS), dtype=np.uint64))

INDEX = "places binary, ids binary, terms binary, most binary, width long, slices binary"


def places_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Signature bits of term hashes, one row per term."""
    h = mix(hashes[:, None] ^ _SALTS[None, :]) >> np.uint64(32)
    return ((h * np.uint64(width)) >> np.uint64(32)).astype(np.int64)


def level_hashes(hashes: np.ndarray, level: int) -> np.ndarray:
    return hashes ^ _LEVEL_SALTS[level]


@dataclass
class Described:
    keys: np.ndarray  # hashes of all terms and levels
    terms: int
    most: int


def describe(raw: bytes | None) -> Described:
    counts = Counter(alnum_words(raw))
    if not counts:
        return Described(np.zeros(0, np.uint64), 0, 0)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts))
    times = np.fromiter(counts.values(), np.int64, len(counts))
    keys = [level_hashes(hashes[times >= least], i) for i, least in enumerate(LEVELS)]
    return Described(np.concatenate(keys), int(times.sum()), int(times.max()))


def sliced(docs: list[Described], width: int) -> bytes:
    """``width`` bitmaps over the documents."""
    bits = np.zeros((width, len(docs)), bool)
    for d, doc in enumerate(docs):
        bits[places_of(doc.keys, width).ravel(), d] = True
    return np.packbits(bits, axis=1).tobytes()


def index_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (place, id, text) batches, documents with similar numbers of terms together."""
    for b in batches:
        place, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
        described = [describe(t) for t in b.column(2).to_pylist()]
        order = sorted((i for i, d in enumerate(described) if d.terms), key=lambda i: len(described[i].keys))
        rows, at = [], 0
        while at < len(order):
            least = len(described[order[at]].keys)
            end = at + 1
            while end < len(order):
                keys = len(described[order[end]].keys)
                size = end + 1 - at
                if keys > 32 + 1.25 * least or size > BLOCK_DOCUMENTS or keys * BITS_PER_KEY * size > BLOCK_BITS:
                    break
                end += 1
            own = order[at:end]
            width = BITS_PER_KEY * len(described[own[-1]].keys)
            rows.append({
                "places": np.array([place[i] for i in own], np.int64).tobytes(),
                "ids": np.array([LAST_ID if ids[i] is None else ids[i] for i in own], np.int64).tobytes(),
                "terms": np.array([described[i].terms for i in own], np.int64).tobytes(),
                "most": np.array([described[i].most for i in own], np.int64).tobytes(),
                "width": width, "slices": sliced([described[i] for i in own], width),
            })
            at = end
        yield pa.RecordBatch.from_pylist(rows, schema=_INDEX_ARROW)


_INDEX_ARROW = pa.schema([
    ("places", pa.binary()), ("ids", pa.binary()), ("terms", pa.binary()), ("most", pa.binary()),
    ("width", pa.int64()), ("slices", pa.binary()),
])


@dataclass
class Index:
    corpus: DataFrame  # place, id, raw
    blocks: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Index ``docs`` (integer ids); texts are kept beside it for exact scores."""
    small_batches(docs.sparkSession)
    corpus = docs.select(
        F.monotonically_increasing_id().alias("place"), F.col(key).cast("long").alias("id"), utf8(F.col(text)).alias("raw"))
    corpus = write_table(corpus, "corpus")
    blocks = write_table(corpus.mapInArrow(index_blocks, INDEX), "signatures")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = terms = 0
        for b in batches:
            for raw in b.column(0).to_pylist():
                n += len(raw) // 8
                terms += int(np.frombuffer(raw, np.int64).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([terms])], names=["n", "terms"])

    sums = blocks.select("terms").mapInArrow(totals, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    return Index(corpus, blocks, sums[0] or 0, sums[1] or 0)


# ---- queries


@dataclass
class Queries:
    """A block of items: for each use of a term (item by item) the term and its weight times its repeats."""

    names: list[int]
    terms: dict[bytes, int]
    hashes: np.ndarray
    weights: np.ndarray       # per term
    used: np.ndarray          # term of each use
    repeats: np.ndarray
    starts: np.ndarray        # first use of each item
    documents: int
    length: int

    def norm(self, terms: np.ndarray) -> np.ndarray:
        return 25 + (75 * terms * self.documents) // self.length


def parse_items(items: list[tuple[int, bytes | None]]) -> tuple[list[tuple[int, Counter]], dict[bytes, int]]:
    parsed = [(no, Counter(alnum_words(raw))) for no, raw in items]
    terms: dict[bytes, int] = {}
    for _, counts in parsed:
        for term in counts:
            terms.setdefault(term, len(terms))
    return parsed, terms


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def as_queries(parsed, terms: dict[bytes, int], df: dict[int, int], index: Index) -> Queries:
    """Terms that no document holds are left out, and items that have no other."""
    held = {t: i for t, i in terms.items() if df.get(i)}
    number = {t: k for k, t in enumerate(held)}
    names, used, repeats, starts = [], [], [], []
    for no, counts in parsed:
        own = [(number[t], n) for t, n in counts.items() if t in number]
        if own:
            names.append(no)
            starts.append(len(used))
            used += [t for t, _ in own]
            repeats += [n for _, n in own]
    as_array = lambda x: np.asarray(x, np.int64)
    return Queries(
        names, number, np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number)),
        as_array([weight(df[terms[t]], index.documents) for t in number]), as_array(used), as_array(repeats),
        as_array(starts), index.documents, index.terms)


def part_score(times: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * times) // (1000 * times + 8 * norm)


def upper_bounds(block: dict, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, ids, and an (items, documents) array of bounds that no score exceeds."""
    places, ids, terms, most = (np.frombuffer(block[k], np.int64) for k in ("places", "ids", "terms", "most"))
    n, width = len(places), block["width"]
    slices = np.frombuffer(block["slices"], np.uint8).reshape(width, -1)
    norm = q.norm(terms)
    bounds = np.zeros((len(q.names), n), np.int64)
    before = np.zeros(n, np.int64)
    alive = np.arange(len(q.hashes))
    for i in range(len(LEVELS)):
        above = np.minimum(most, LEVELS[i + 1] - 1) if i + 1 < len(LEVELS) else most
        gain = np.maximum(part_score(np.maximum(above, 1), norm) - before, 0)
        before += gain
        at = places_of(level_hashes(q.hashes[alive], i), width)
        held = slices[at[:, 0]]
        for k in range(1, HASHES):
            held = held & slices[at[:, k]]
        some = held.any(axis=1)
        alive, held = alive[some], held[some]
        if not len(alive):
            break
        bits = np.unpackbits(held, axis=1, count=n)
        row = np.full(len(q.hashes), -1)
        row[alive] = np.arange(len(alive))
        uses = np.flatnonzero(row[q.used] >= 0)
        item = np.searchsorted(q.starts, uses, side="right") - 1
        share = (q.weights[q.used] * q.repeats)[uses]
        for a in range(0, len(uses), 2048):
            own, who = uses[a : a + 2048], item[a : a + 2048]
            sums = bits[row[q.used[own]]] * share[a : a + 2048, None]
            first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
            bounds[who[first]] += np.add.reduceat(sums, first, axis=0) * gain
    return places, ids, bounds


def best(scores: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k greatest scores above 0, smaller ids first among equals."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        limit = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= limit]
    return some[np.lexsort((places[some], ids[some], -scores[some]))][:k]


FOUND = "item long, place long, id long, bound long"
_FOUND_ARROW = pa.schema([("item", pa.int64()), ("place", pa.int64()), ("id", pa.int64()), ("bound", pa.int64())])


def highest_bounds(shared, k: int):
    """Per task and item the k documents with the highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        kept = [np.zeros((3, 0), np.int64) for _ in q.names]  # bound, id, place
        for b in batches:
            for block in b.to_pylist():
                places, ids, bounds = upper_bounds(block, q)
                for i, row in enumerate(bounds):
                    least = kept[i][0, -1] if kept[i].shape[1] == k else 1
                    near = np.flatnonzero(row >= least)
                    if len(near):
                        both = np.concatenate((kept[i], np.stack((row[near], ids[near], places[near]))), axis=1)
                        kept[i] = both[:, best(both[0], both[1], both[2], k)]
        for no, own in zip(q.names, kept):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(own.shape[1], no)), pa.array(own[2]), pa.array(own[1]), pa.array(own[0])], schema=_FOUND_ARROW)

    return run


def not_excluded(shared):
    """All documents whose bound does not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, limits = shared.value
        score = np.array([limits.get(no, (0, 0))[0] for no in q.names])[:, None]
        last = np.array([limits.get(no, (0, 0))[1] for no in q.names])[:, None]
        for b in batches:
            for block in b.to_pylist():
                places, ids, bounds = upper_bounds(block, q)
                item, doc = np.nonzero((bounds > 0) & ((bounds > score) | ((bounds == score) & (ids[None, :] <= last))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(q.names, np.int64)[item]), pa.array(places[doc]), pa.array(ids[doc]),
                     pa.array(bounds[item, doc])], schema=_FOUND_ARROW)

    return run


def term_counts(shared):
    """In how many of its documents each term stands, per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        known = terms.keys()
        n = np.zeros(len(terms), np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                held = known & set(alnum_words(raw))
                if held:
                    n[[terms[t] for t in held]] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["term", "n"])

    return run


def exact(found: DataFrame, index: Index, shared) -> DataFrame:
    """item, place, id, score of the (item, place) rows in ``found``, from the texts."""

    @F.arrow_udf("array<long>")
    def scores(raw: pa.Array, items: pa.Array) -> pa.Array:
        q = shared.value
        number = {no: i for i, no in enumerate(q.names)}
        ends = np.append(q.starts[1:], len(q.used))
        out = []
        for text, own in zip(raw.to_pylist(), items.to_pylist()):
            words = alnum_words(text)
            counts = Counter(w for w in words if w in q.terms)
            times = np.zeros(len(q.hashes), np.int64)
            for t, c in counts.items():
                times[q.terms[t]] = c
            part = q.weights * part_score(times, q.norm(np.array([len(words)])))
            whole = part[q.used] * q.repeats
            out.append([int(whole[q.starts[i] : ends[i]].sum()) for i in (number[no] for no in own)])
        return pa.array(out, pa.list_(pa.int64()))

    asked = found.groupBy("place").agg(F.collect_set("item").alias("items"))
    scored = asked.join(index.corpus, "place").withColumn("scores", scores(F.col("raw"), F.col("items"))).select(
        "place", "id", F.explode(F.arrays_zip("items", "scores")).alias("z"))
    return scored.select(F.col("z.items").alias("item"), "place", "id", F.col("z.scores").alias("score")).filter("score > 0")


def first_of(scored: DataFrame, value: str, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc(value), F.asc_nulls_last("id"), "place")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, items: DataFrame, key: str = "item_id", text: str = "text", top: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` best documents."""
    spark = items.sparkSession
    asked = write_table(items.select(
        F.monotonically_increasing_id().alias("item"), F.col(key).alias("item_id"), utf8(F.col(text)).alias("raw")), "items")
    size = asked.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    parts = -(-size // item_bytes) if index.documents else 0
    out = spark.createDataFrame([], "item long, place long, id long, score long, rank int")
    for part in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).select("item", "raw").collect()
        found = search_block(index, [(r.item, bytes(r.raw) if r.raw is not None else None) for r in rows], top)
        if found is not None:
            out = out.unionByName(found)
    return asked.select("item", "item_id").join(out, "item").select(
        "item_id", "rank", F.col("id").alias("doc_id"), "score")


def search_block(index: Index, items: list[tuple[int, bytes | None]], top: int = TOP) -> DataFrame | None:
    context = index.corpus.sparkSession.sparkContext
    parsed, terms = parse_items(items)
    known = context.broadcast(terms)
    counts = index.corpus.select("raw").mapInArrow(term_counts(known), "term long, n long")
    df = {r.term: r.n for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    q = as_queries(parsed, terms, df, index)
    if not q.names:
        return None
    shared = context.broadcast(q)
    likely = first_of(index.blocks.mapInArrow(highest_bounds(shared, max(SEEDS, top)), FOUND), "bound", max(SEEDS, top))
    seeds = write_table(exact(likely.select("item", "place"), index, shared), "seed-scores")
    # The k-th best score so far, with its id; items with fewer seeds have no limit yet.
    limits = {r.item: (r.score, LAST_ID if r.id is None else r.id)
              for r in first_of(seeds, "score", top).filter(F.col("rank") == top).collect()}
    left = index.blocks.mapInArrow(not_excluded(context.broadcast((q, limits))), FOUND).select("item", "place")
    rest = left.join(seeds.select("item", "place"), ["item", "place"], "left_anti")
    scored = seeds.unionByName(exact(rest, index, shared))
    return write_table(first_of(scored, "score", top), "hits")
