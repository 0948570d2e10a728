"""Benchmark decontamination with suffix arrays.

Each Arrow batch of documents is a shard. Its text is reduced to the stretches made of words that the
test set knows at all (nothing else can match), a suffix array of those stretches is sorted by prefix
doubling, and every suffix of every test item is searched in it by bisection, all suffixes at once. That
gives each suffix's longest verbatim match and where it lies; where it is at least one window long, the
block of the array that shares the whole window gives all its places. Documents never leave their rows:
the search is an Arrow function on the text column, with no shuffle.

The test set is a stated query set and is taken in blocks of ``BLOCK_BYTES`` of text, each broadcast on its
own, so a large one costs more passes and not more memory. The driver reads it row by row.

Defined results: null and wordless texts have no words, no hits and no items; a null or wordless item
matches nothing; a null item_id counts as an item named "" ; items with the same text all count; repeated
document rows are each judged alone; an empty test set leaves every document clean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import alnum_words, held, unused_name, utf8

WINDOW = 10
BLOCK_BYTES = 4 << 20
VERDICT = "n_words long, n_hit long, items array<string>, longest long, longest_at long, hits binary"


@dataclass
class TestBlock:
    """Items as one line of word numbers (0 ends an item), and its windows."""

    vocabulary: dict[bytes, int]
    line: np.ndarray
    suffixes: np.ndarray      # start of every suffix that begins a window or could hold a longer match
    left: np.ndarray          # words from there to the end of the item
    lengths: np.ndarray       # words of the window that begins there; 0: none
    owner: np.ndarray         # item of each suffix
    names: list[str]
    shortest: int


def test_block(items: list[tuple[str, bytes]], window: int = WINDOW) -> TestBlock:
    vocabulary: dict[bytes, int] = {}
    line, starts, left, lengths, owner, names = [0], [], [], [], [], []
    for name, raw in items:
        words = alnum_words(raw)
        if not words:
            continue
        n = len(words)
        at = len(line)
        line += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        line.append(0)
        starts += range(at, at + n)
        left += range(n, 0, -1)
        size = min(window, n)
        lengths += [size if i + size <= n else 0 for i in range(n)]
        owner += [len(names)] * n
        names.append(name)
    as_array = lambda x: np.asarray(x, np.int64)
    sizes = as_array(lengths)
    return TestBlock(
        vocabulary, as_array(line), as_array(starts), as_array(left), sizes, as_array(owner), names,
        int(sizes[sizes > 0].min()) if len(sizes) else 0,
    )


def suffix_array(line: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``line``, sorted by at least their first ``depth`` words.

    Prefix doubling: the rank by 2k words comes from the ranks by k words of a suffix and of the one k
    words on. Stops early when all suffixes differ.
    """
    n = len(line)
    rank = line.astype(np.int64)
    order, have = np.argsort(rank, kind="stable"), 1
    while True:
        sorted_ = rank[order]
        fresh = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if have >= depth or n == 0 or fresh[-1] == n - 1:
            return order
        beyond = np.zeros(n, np.int64)
        beyond[: n - have] = rank[have:] + 1
        rank = rank * (n + 1) + beyond
        order, have = np.argsort(rank, kind="stable"), 2 * have


def common_words(line, at, other, place, most):
    """Words shared from ``line[at]`` and ``other[place]`` on, pair by pair, up to ``most`` each."""
    shared = np.zeros(len(at), np.int64)
    live = np.flatnonzero((at < len(line)) & (at >= 0) & (most > 0))
    while len(live):
        a, b = at[live] + shared[live], place[live] + shared[live]
        fine = a < len(line)
        fine[fine] = line[a[fine]] == other[b[fine]]
        live = live[fine]
        shared[live] += 1
        live = live[shared[live] < most[live]]
    return shared


def bisect(line, order, other, place, most, upper=False):
    """For each ``other[place:place+most]``: how many suffixes are smaller (``upper``: or begin with it)."""
    low, high = np.zeros(len(place), np.int64), np.full(len(place), len(order))
    while len(live := np.flatnonzero(low < high)):
        middle = (low[live] + high[live]) // 2
        at = order[middle]
        shared = common_words(line, at, other, place[live], most[live])
        whole = shared >= most[live]
        a, b = at + shared, place[live] + shared
        mine = np.where(a < len(line), line[np.minimum(a, len(line) - 1)], -1)
        smaller = np.where(whole, upper, mine < other[np.minimum(b, len(other) - 1)])
        low[live] = np.where(smaller, middle + 1, low[live])
        high[live] = np.where(smaller, high[live], middle)
    return low


class Shard:
    """The stretches of a batch of documents that consist of words of the test set."""

    def __init__(self, texts: list[bytes | None], block: TestBlock):
        self.words = np.zeros(len(texts), np.int64)
        lines, docs, places = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        known, shortest = block.vocabulary.get, block.shortest
        for d, raw in enumerate(texts):
            words = alnum_words(raw)
            self.words[d] = len(words)
            if not shortest or len(words) < shortest:
                continue
            ids = np.fromiter((known(w, 0) for w in words), np.int64, len(words))
            edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
            for a, b in zip(edges[::2], edges[1::2]):
                if b - a >= shortest:
                    lines += (ids[a:b], np.zeros(1, np.int64))
                    docs.append(np.full(b - a + 1, d))
                    places.append(np.arange(a, b + 1))
        self.line, self.doc, self.place = map(np.concatenate, (lines, docs, places))


def search(texts: list[bytes | None], block: TestBlock):
    """Per document: words, mask of hit words, item numbers, longest match and its place (or -1)."""
    shard = Shard(texts, block)
    n = len(texts)
    masks = [np.zeros(w, bool) for w in shard.words]
    items: list[set[int]] = [set() for _ in range(n)]
    longest, longest_at = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    if len(shard.line) > 1 and len(block.suffixes):
        line, order = shard.line, suffix_array(shard.line, int(block.left.max()))
        spot = bisect(line, order, block.line, block.suffixes, block.left)
        around = [
            common_words(line, np.where((k >= 0) & (k < len(order)), order[np.clip(k, 0, len(order) - 1)], -1),
                         block.line, block.suffixes, block.left)
            for k in (spot - 1, spot)
        ]
        match = np.maximum(*around)
        found = np.flatnonzero((block.lengths > 0) & (match >= block.lengths))
        low = bisect(line, order, block.line, block.suffixes[found], block.lengths[found])
        high = bisect(line, order, block.line, block.suffixes[found], block.lengths[found], upper=True)
        for f, a, b in zip(found, low, high):
            at = order[a:b]
            size, docs, places = block.lengths[f], shard.doc[at], shard.place[at]
            reach = common_words(line, at, block.line, np.full(len(at), block.suffixes[f]),
                                 np.full(len(at), block.left[f]))
            for d, p, r in zip(docs, places, reach):
                masks[d][p : p + size] = True
                items[d].add(int(block.owner[f]))
                if r > longest[d]:
                    longest[d], longest_at[d] = r, p
    return shard.words, masks, items, longest, longest_at


def contamination(text: Column, block) -> Column:
    """Verdict on a text against one broadcast block of the test set."""

    @F.arrow_udf(VERDICT)
    def judge(raw: pa.Array) -> pa.Array:
        held("decontam", object)  # frees what an earlier stage kept
        b = block.value
        words, masks, items, longest, at = search(raw.to_pylist(), b)
        return pa.StructArray.from_arrays(
            [
                pa.array(words), pa.array([int(m.sum()) for m in masks], pa.int64()),
                pa.array([sorted({b.names[i] for i in s}) for s in items], pa.list_(pa.string())),
                pa.array(longest), pa.array([None if x < 0 else int(x) for x in at], pa.int64()),
                pa.array([np.packbits(m).tobytes() if m.any() else None for m in masks], pa.binary()),
            ],
            names=["n_words", "n_hit", "items", "longest", "longest_at", "hits"],
        )

    return judge(utf8(text))


def both_verdicts(one: Column, two: Column) -> Column:
    """Verdicts on the same text against two blocks, as one."""

    @F.arrow_udf(VERDICT)
    def merge(one: pa.Array, two: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(one.to_pylist(), two.to_pylist()):
            marks = [np.frombuffer(x["hits"], np.uint8) for x in (a, b) if x["hits"] is not None]
            merged = np.bitwise_or.reduce(marks) if marks else None
            best = max(a, b, key=lambda x: x["longest"])
            out.append({
                "n_words": a["n_words"], "n_hit": int(np.unpackbits(merged).sum()) if marks else 0,
                "items": sorted({*a["items"], *b["items"]}), "longest": best["longest"],
                "longest_at": best["longest_at"], "hits": merged.tobytes() if marks else None,
            })
        return pa.array(out, one.type)

    return merge(one, two)


def test_blocks(tests: DataFrame, key: str, text: str, window: int, block_bytes: int):
    rows = tests.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), utf8(F.col(text)).alias("t"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r.k, bytes(r.t) if r.t is not None else None))
        size += len(r.t or b"")
        if size >= block_bytes:
            yield test_block(block, window)
            block, size = [], 0
    if block or not size:
        yield test_block(block, window)


def with_verdict(
    docs: DataFrame, tests: DataFrame, name: str, text: str = "text", test_key: str = "item_id",
    test_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, n_hit, items, longest, longest_at, hits."""
    context, done = docs.sparkSession.sparkContext, False
    for block in test_blocks(tests, test_key, test_text, window, block_bytes):
        verdict = contamination(F.col(text), context.broadcast(block))
        if done:
            more = unused_name(docs, "more")
            docs = docs.withColumn(more, verdict).withColumn(name, both_verdicts(F.col(name), F.col(more))).drop(more)
        else:
            docs, done = docs.withColumn(name, verdict), True
    return docs


def decontaminate(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that share no window with the test set, columns as given."""
    name = unused_name(docs, "verdict")
    return with_verdict(docs, tests, name, **options).filter(F.col(name)["n_hit"] == 0).drop(name)
