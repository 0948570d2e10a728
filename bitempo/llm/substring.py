"""Substring deduplication with FM-indexes.

A word is removed if a window of ``WINDOW`` words that covers it also starts earlier in the corpus. Equal windows
must meet in one place, so windows are routed by their minimizer, the least hash among their word
``GRAM``-grams: neighbouring windows mostly share it and travel as one piece of text, and equal windows
always share it. Pieces whose minimizer occurs once cannot repeat and are left where they are. A
minimizer that very many pieces share (a line that stands in a third of all documents) would make one
shard too large: its windows are routed one by one, by the hash of the whole window.

1. Pieces as (minimizer, document, start, windows): narrow rows; occurrences are counted by minimizer.
2. The text of pieces whose minimizer repeats, reduced to distinct texts before the shuffle; each keeps
   its earliest place. Every other copy of a piece is a repeat from end to end.
3. Shards of some million words, cut between minimizers, each get a compressed FM-index: the
   Burrows-Wheeler transform of the shard's word numbers, sorted to the depth of a window, in a wavelet
   matrix of packed bits with block counts. The pieces are streamed through it from right to left by
   backward search, all pieces of the shard side by side. The match is kept one word short of the window
   by moving to the enclosing interval, so each step yields the matching statistic at its word: an interval
   of at least the window's length is reported, and its earliest place decides.
4. Marks return to their documents, whose kept words are joined.

Nothing depends on how many copies there are: each step's work is linear in the text.

Defined results: null and wordless texts have no words and keep nothing; texts shorter than a window keep
all; rows that agree in id and text count as one document and get the same result each; rows of one id and
different texts are documents in the order of a hash of the text; null ids come first; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import (
    WordHashes, drop_table, gram_hashes, held, ragged, release_shuffles, space_words, struct_array, utf8, write_table,
)

WINDOW = 20
GRAM = 5
PIECE = 256
HOT = 10_000
SHARD_WORDS = 1 << 20


# ---- pieces


def sliding_minimum(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def pieces(texts: list[bytes | None], window: int = WINDOW, gram: int = GRAM):
    """Row, start, windows, minimizer and its occurrences in every piece of a batch of texts."""
    words, sizes = [], np.zeros(len(texts), np.int64)
    for d, raw in enumerate(texts):
        own = space_words(raw)
        sizes[d] = len(own)
        words += own
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none, none, none
    row = np.repeat(np.arange(len(texts)), sizes)
    grams = gram_hashes(held("substring", WordHashes)(words), gram)
    least = sliding_minimum(grams, window - gram + 1)
    at = np.flatnonzero(row[: len(least)] == row[window - 1 :])
    if not len(at):
        return none, none, none, none, none
    key = least[at].view(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(new)
    along = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(along % PIECE == 0)
    n = np.diff(np.append(first, len(at)))
    starts = np.cumsum(sizes) - sizes
    rows = row[at[first]]
    piece, along = ragged(n + window - gram)
    same = grams.view(np.int64)[at[first][piece] + along] == key[first][piece]
    times = np.bincount(piece[same], minlength=len(first))
    return rows, at[first] - starts[rows], n, key[first], times


def minimizers(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, *columns, key, times = pieces(b.column(1).to_pylist(), window, gram)
            start, n, times = (pa.array(x.astype(np.int32)) for x in (*columns, times))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), b.column(0).take(pa.array(row)), start, n, times],
                names=["key", "no", "start", "n", "times"],
            )

    return docs.select("no", utf8(F.col("text"))).mapInArrow(run, "key long, no long, start int, n int, times int")


CONTENT = "array<struct<route: long, digest: binary, start: int, n: int, content: binary>>"
CONTENT_ARROW = pa.list_(pa.struct([
    ("route", pa.int64()), ("digest", pa.binary()), ("start", pa.int32()), ("n", pa.int32()), ("content", pa.binary())]))


def contents(text: Column, wanted: Column, window: int) -> Column:
    """The text of the wanted pieces (structs key, start, n, hot); a hot piece window by window."""

    @F.arrow_udf(CONTENT)
    def cut(raw: pa.Array, asked: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(raw.to_pylist(), asked.to_pylist()):
            words, found = space_words(t), []
            for p in own:
                for a, n in ((p["start"] + i, 1) for i in range(p["n"])) if p["hot"] else ((p["start"], p["n"]),):
                    content = b" ".join(words[a : a + n + window - 1])
                    digest = xxhash.xxh3_128_digest(content)
                    route = int.from_bytes(digest[:8], "little", signed=True) if p["hot"] else p["key"]
                    found.append({"route": route, "digest": digest, "start": a, "n": n, "content": content})
            out.append(found)
        return pa.array(out, CONTENT_ARROW)

    return cut(utf8(text), wanted)


# ---- the index


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit vector per bit of the symbols, highest bit first."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (sequence >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, "<u8")
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.bitwise_count(words).astype(np.int64)
            self.bits.append(words)
            self.counts.append(np.cumsum(ones) - ones)
            zero = bit == 0
            self.zeros.append(int(zero.sum()))
            sequence = np.concatenate((sequence[zero], sequence[~zero]))
        self.base = self.descend(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            below = self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[k][word] + np.bitwise_count(below)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self.descend(symbol, at) - self.base[symbol]


class FMIndex:
    """Backward search for strings of up to ``depth`` words over a line of word numbers (0 separates)."""

    def __init__(self, line: np.ndarray, symbols: int, depth: int):
        n = len(line)
        ranks = [line]
        have = 1
        while have * 2 <= depth:
            ranks.append(self._both(ranks[-1], ranks[-1], have))
            have *= 2
        # One word short of the window, and the window itself: both from overlapping halves.
        shorter = self._both(ranks[-1], ranks[-1], depth - 1 - have) if depth - 1 > have else ranks[-1]
        longer = self._both(ranks[-1], ranks[-1], depth - have) if depth > have else ranks[-1]
        if depth - 1 < have:
            shorter = self._both(ranks[-2], ranks[-2], depth - 1 - have // 2)
        self.order = np.argsort(longer, kind="stable")
        self.group_starts, self.group_of = self._groups(longer[self.order])
        starts, of = self._groups(shorter[self.order])
        ends = np.append(starts[1:], n)
        self.low, self.high = starts[of], ends[of]
        self.transform = WaveletMatrix(line[self.order - 1], symbols)
        times = np.bincount(line, minlength=symbols)
        self.before = np.cumsum(times) - times

    @staticmethod
    def _both(one: np.ndarray, two: np.ndarray, distance: int) -> np.ndarray:
        """Dense ranks of (one[i], two[i + distance])."""
        beyond = np.zeros(len(two), np.int64)
        beyond[: len(two) - distance] = two[distance:] + 1
        key = one * (int(two.max()) + 2) + beyond
        order = np.argsort(key, kind="stable")
        fresh = key[order]
        out = np.empty(len(one), np.int64)
        out[order] = np.concatenate(([0], np.cumsum(fresh[1:] != fresh[:-1])))
        return out

    @staticmethod
    def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.concatenate(([True], values[1:] != values[:-1]))
        return np.flatnonzero(new), np.cumsum(new) - 1

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the strings with one more word in front."""
        both = self.transform.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return self.before[symbol] + both[: len(low)], self.before[symbol] + both[len(low) :]


def repeats(texts: list[bytes], document: np.ndarray, start: np.ndarray, window: int) -> list[np.ndarray]:
    """For each piece: which of its windows also start earlier in the shard."""
    number: dict[bytes, int] = {}
    parts, sizes = [np.zeros(1, np.int64)], []
    for t in texts:
        own = t.split()
        parts += (np.fromiter((number.setdefault(w, len(number) + 1) for w in own), np.int64, len(own)), parts[0])
        sizes.append(len(own))
    line, sizes = np.concatenate(parts), np.array(sizes)
    index = FMIndex(line, len(number) + 1, window)
    # Places in corpus order: document first, then the word within it.
    first = np.cumsum(sizes + 1) - sizes
    _, rank = np.unique(document, return_inverse=True)
    place = np.full(len(line), np.iinfo(np.int64).max)
    at = np.repeat(first, sizes) + (along := np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    place[at] = np.repeat((rank << 32) + start, sizes) + along
    earliest = np.minimum.reduceat(place[index.order], index.group_starts)

    lanes = np.argsort(-sizes, kind="stable")
    low, high = np.zeros(len(lanes), np.int64), np.full(len(lanes), len(line))
    found = np.zeros(len(line), bool)
    for step in range(1, int(sizes.max()) + 1):
        live = int(np.searchsorted(-sizes[lanes], -step, side="right"))
        here = first[lanes[:live]] + sizes[lanes[:live]] - step
        low[:live], high[:live] = index.extend(line[here], low[:live], high[:live])
        if step >= window:
            # The interval is as long as the window: report it, and fall back to one word less.
            group = index.group_of[low[:live]]
            found[here] = earliest[group] < place[here]
            low[:live], high[:live] = index.low[low[:live]], index.high[low[:live]]
    return [found[f : f + s - window + 1] for f, s in zip(first, sizes)]


MARKS = "no long, start int, n int, mask binary"


def search_shards(firsts: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Marks of all distinct pieces. Shards are cut between routes of a partition sorted by route."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marks(rows: list[dict]) -> pa.RecordBatch:
            masks = repeats([r["content"] for r in rows], np.array([r["no"] for r in rows], np.int64),
                            np.array([r["start"] for r in rows], np.int64), window)
            return pa.RecordBatch.from_arrays(
                [pa.array([r["no"] for r in rows], pa.int64()), pa.array([r["start"] for r in rows], pa.int32()),
                 pa.array([r["n"] for r in rows], pa.int32()),
                 pa.array([np.packbits(m).tobytes() if m.any() else None for m in masks], pa.binary())],
                names=["no", "start", "n", "mask"],
            )

        held, words = [], 0
        for b in batches:
            for r in b.to_pylist():
                if words >= shard_words and r["route"] != held[-1]["route"]:
                    yield marks(held)
                    held, words = [], 0
                held.append(r)
                words += r["n"] + window - 1
        if held:
            yield marks(held)

    dealt = firsts.repartition("route").sortWithinPartitions("route", "no", "start")
    return dealt.select("route", "no", "start", "n", "content").mapInArrow(run, MARKS)


# ---- the operator


def numbered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """Documents as (no, text), ``no`` unique and in corpus order; and (no, id, rows) where ids are not that."""
    base = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    odd = base.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 OR id IS NULL")
    if odd.isEmpty():
        return base.select(F.col("id").alias("no"), "text"), None
    hashed = base.withColumn("h", F.xxhash64("text"))
    line = write_table(
        hashed.groupBy("id", "h").agg(F.count(F.lit(1)).alias("rows")).repartitionByRange("id", "h")
        .sortWithinPartitions("id", "h").withColumn("no", F.monotonically_increasing_id()), "line")
    one = hashed.groupBy("id", "h").agg(F.first("text").alias("text"))
    same = line["id"].eqNullSafe(one["id"]) & (line["h"] == one["h"])
    return write_table(one.join(line, same).select("no", "text"), "numbered"), line.select("no", "id", "rows")


def removal(text: Column, marks: Column, window: int) -> Column:
    """Struct n_words, n_removed, kept_sha256, kept (removed words as bits) of a text and its marks."""

    @F.arrow_udf("n_words long, n_removed long, kept_sha256 string, removed binary")
    def judge(raw: pa.Array, marked: pa.Array) -> pa.Array:
        counts, gone, shas, bits = [], [], [], []
        for t, own in zip(raw.to_pylist(), marked.to_pylist()):
            words = space_words(t)
            cover = np.zeros(len(words) + 1, np.int64)
            for m in own or ():
                whole = np.ones(m["n"], bool) if m["mask"] is None else np.unpackbits(
                    np.frombuffer(m["mask"], np.uint8), count=m["n"]).astype(bool)
                at = m["start"] + np.flatnonzero(whole)
                cover[at] += 1
                cover[at + window] -= 1
            removed = np.cumsum(cover)[:-1] > 0
            kept = [words[i] for i in np.flatnonzero(~removed)] if own else words
            counts.append(len(words))
            gone.append(int(removed.sum()))
            shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            bits.append(np.packbits(removed).tobytes() if removed.any() else None)
        return struct_array(n_words=pa.array(counts, pa.int64()), n_removed=pa.array(gone, pa.int64()),
                            kept_sha256=pa.array(shas, pa.string()), removed=pa.array(bits, pa.binary()))

    return judge(utf8(text), marks)


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
    hot: int = HOT, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256, removed (a bit per word)."""
    spark = docs.sparkSession
    base, names = numbered(docs, key, text)
    narrow = write_table(minimizers(base, window, gram), "pieces")
    # A minimizer that stands twice in one piece may begin a repeat within it.
    often = narrow.groupBy("key").agg(F.sum("times").alias("c")).filter("c > 1")
    wanted = write_table(
        narrow.join(often, "key").select("no", F.struct("key", "start", "n", (F.col("c") > hot).alias("hot")).alias("p"))
        .groupBy("no").agg(F.collect_list("p").alias("wanted")), "wanted")
    drop_table(narrow)
    release_shuffles(spark)
    found = base.join(wanted, "no").select("no", F.explode(contents(F.col("text"), F.col("wanted"), window)).alias("p"))
    found = write_table(found.select("no", "p.*"), "contents")
    drop_table(wanted)
    release_shuffles(spark)
    # The earliest place of each distinct piece; the same text always has the same route.
    firsts = write_table(
        found.groupBy("route", "digest").agg(F.min(F.struct("no", "start", "n", "content")).alias("f"))
        .select("route", "digest", "f.*"), "firsts")
    release_shuffles(spark)
    copies = found.select("route", "digest", "no", "start", "n").join(
        firsts.select("route", "digest", F.col("no").alias("f_no"), F.col("start").alias("f_start")), ["route", "digest"])
    copies = copies.filter("no <> f_no OR start <> f_start").select("no", "start", "n", F.lit(None).cast("binary").alias("mask"))
    own = search_shards(firsts, window, shard_words).filter("mask IS NOT NULL")
    marks = write_table(
        copies.unionByName(own).groupBy("no").agg(F.collect_list(F.struct("start", "n", "mask")).alias("marks")), "marks")
    drop_table(found)
    drop_table(firsts)
    release_shuffles(spark)
    judged = base.join(marks, "no", "left").select("no", removal(F.col("text"), F.col("marks"), window).alias("r"))
    judged = judged.select("no", "r.*")
    if names is None:
        return judged.withColumnRenamed("no", "id")
    return judged.join(names, "no").withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop(
        "no", "rows", "one")
