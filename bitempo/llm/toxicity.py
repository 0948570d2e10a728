"""Toxicity: averaged subword embeddings under a linear softmax.

A word is the mean of the vectors of its byte n-grams, so a misspelling never seen shares most of its
vectors with the word it comes from. A stretch of ``STRETCH`` words is the mean of its words, and a linear
softmax tells how likely it is toxic; a document is as toxic as its worst stretch, so a few words decide
in a short text and in a very long one alike. Vectors and softmax are trained jointly (Adagrad, full
batches, numpy): first on whole documents, which finds the words that only toxic ones have, then on each
document's worst stretch, which calibrates the score that is used.

Training takes at most ``TRAIN_ROWS`` different labelled texts per class, drawn by a hash of the text, and at most
``TRAIN_BYTES`` of text, half for each class. Copies of a text are drawn as one. Where the drawn texts of a class
are larger than its half, its longest are trained on in part: ``PIECES`` evenly spread pieces of them, all cut to
the same number of bytes, so that every drawn text teaches; scoring is an Arrow function over all whole texts. Only the product of vectors and
softmax is needed to score (one number per n-gram cell), which is what is broadcast.

Defined results: null, empty and wordless texts score 0; rows with a null label teach nothing; without
examples of both classes everything scores 0; the same text has the same score everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import WordTable, alnum_words, byte_grams, utf8

CELLS = 1 << 17
GRAMS = (3, 4, 5)
WIDTH = 16
STRETCH = 4
TRAIN_ROWS = 2_000
TRAIN_BYTES = 16 << 20
PIECES = 8
WHOLE_ROUNDS, STRETCH_ROUNDS = 50, 90
RATE = 1.0
DECAY = 1e-4


@dataclass
class ToxicityModel:
    cells: np.ndarray   # evidence of each n-gram cell for class 1 over class 0
    bias: float
    empty: bool = False


def word_cells(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a word's n-grams and of the word itself, grouped by word."""
    grams, owner = byte_grams(words, GRAMS)
    whole = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    cells = np.concatenate((grams, whole)) % np.uint64(CELLS)
    owner = np.concatenate((owner, np.arange(len(words))))
    return cells.astype(np.int64), owner


def word_evidence(words: list[bytes], cells: np.ndarray) -> np.ndarray:
    at, owner = word_cells(words)
    return np.bincount(owner, cells[at], len(words)) / np.bincount(owner, minlength=len(words))


def worst_stretch(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document with words: mean, first word and number of words of its highest stretch."""
    starts = np.cumsum(sizes) - sizes
    total = np.concatenate(([0.0], np.cumsum(values)))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values))
    stop = np.minimum(place + STRETCH, (starts + sizes)[doc])
    first = np.maximum(stop - STRETCH, starts[doc])
    means = (total[stop] - total[first]) / (stop - first)
    top = np.maximum.reduceat(means, starts) if len(sizes) else means
    hits = np.flatnonzero(means == top[doc])
    _, where = np.unique(doc[hits], return_index=True)
    best = hits[where]
    return top, first[best], (stop - first)[best]


def train(texts: list[bytes], labels: np.ndarray, seed: int = 5) -> ToxicityModel:
    """Fit vectors and softmax on these texts (bounded by the caller)."""
    lines = [alnum_words(t) for t in texts]
    keep = [i for i, w in enumerate(lines) if w]
    labels = np.asarray(labels, np.float64)[keep]
    lines = [lines[i] for i in keep]
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(np.zeros(CELLS), 0.0, empty=True)
    number: dict[bytes, int] = {}
    line = np.array([number.setdefault(w, len(number)) for own in lines for w in own], np.int64)
    sizes = np.array([len(w) for w in lines], np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    cells, owner = word_cells(list(number))
    per_word = np.bincount(owner, minlength=len(number)).astype(np.float64)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (CELLS, WIDTH))
    softmax = rng.normal(0, 0.1, (2, WIDTH))
    bias = np.zeros(2)
    seen = [np.full(CELLS, 1e-6), np.full((2, WIDTH), 1e-6), np.full(2, 1e-6)]
    # Both classes weigh alike, whatever their share in the sample.
    weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    for step in range(WHOLE_ROUNDS + STRETCH_ROUNDS):
        direction = softmax[1] - softmax[0]
        evidence = np.bincount(owner, (vectors @ direction)[cells], len(number)) / per_word
        values = evidence[line]
        if step < WHOLE_ROUNDS:
            logit = np.bincount(doc, values, len(sizes)) / sizes * np.sqrt(sizes)
            share = 1 / np.sqrt(sizes)
            picked, weights_of = line, share[doc]
            of = doc
        else:
            logit, first, length = worst_stretch(values, sizes)
            at = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
            of = np.repeat(np.arange(len(sizes)), length)
            picked, weights_of = line[at], 1 / length[of]
        logit = logit + bias[1] - bias[0]
        error = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels) * weight
        to_word = np.bincount(picked, error[of] * weights_of, len(number)) / per_word
        to_cell = np.bincount(cells, to_word[owner], CELLS)
        to_direction = to_cell @ vectors
        # Each row of vectors moves along the softmax direction, so one step size per row will do.
        seen[0] += to_cell**2
        vectors -= RATE * (to_cell / np.sqrt(seen[0]))[:, None] * direction
        for target, total, slope in (
            (softmax, seen[1], np.stack((-to_direction, to_direction)) + DECAY * softmax),
            (bias, seen[2], np.array([-error.sum(), error.sum()])),
        ):
            total += slope**2
            target -= 0.1 * RATE * slope / np.sqrt(total)
    return ToxicityModel(vectors @ (softmax[1] - softmax[0]), float(bias[1] - bias[0]))


def longest_part(lengths: list[int], size: int) -> int:
    """The greatest number of bytes so that texts cut to it have no more than ``size`` bytes together."""
    left, part = size, 0
    for i, n in enumerate(sorted(lengths)):
        part = left // (len(lengths) - i)
        if n > part:
            return part
        left -= n
    return max(lengths, default=0)


def spread_part(raw: Column, size: Column, part: Column) -> Column:
    """Bytes of a text, or, where it has more than ``part``, evenly spread pieces with blanks between."""
    piece = F.greatest(F.floor(part / PIECES) - 1, F.lit(1)).cast("int")
    start = lambda i: (F.floor((size - piece) * i / (PIECES - 1)) + 1).cast("int")
    pieces = [F.concat(F.substring(raw, start(i), piece), F.lit(b" ")) for i in range(PIECES)]
    return F.when(size <= part, raw).otherwise(F.concat(*pieces))


def training_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int, size: int):
    """At most ``rows`` different texts of each class and ``size`` bytes in all, by a hash of the text.

    The draw looks at ids, hashes and lengths only; texts, or parts of them, are fetched for the few drawn.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).alias("y"))
    told = docs.filter(F.col(text).isNotNull()).select(
        F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.octet_length(F.col(text)).alias("n"))
    each = told.join(known, "k").groupBy("y", "h").agg(F.min("k").alias("k"), F.min("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("y").orderBy("h"))
    drawn = each.withColumn("place", place).filter(F.col("place") <= rows).select("k", "h", "y", "n")
    schema, drawn = drawn.schema, drawn.collect()
    part = {y: longest_part([r.n for r in drawn if r.y == y], size // 2) for y in {r.y for r in drawn}}
    asked = docs.sparkSession.createDataFrame(
        [(*r, part[r.y]) for r in drawn], schema.add("part", "long"))
    raw = utf8(F.col(text))
    texts = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), raw.alias("t"))
    found = texts.join(F.broadcast(asked), ["k", "h"]).select(
        "y", spread_part(F.col("t"), F.col("n"), F.col("part")).alias("t")).distinct().collect()
    found.sort(key=lambda r: (bytes(r.t), r.y))
    return [bytes(r.t) for r in found], np.array([r.y for r in found])


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES,
) -> ToxicityModel:
    return train(*training_sample(docs, labels, key, text, label, rows, size))


_LAST: list = []


def score(text: Column, model: ToxicityModel, spark) -> Column:
    """Probability that the worst stretch of a text is toxic."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(raw: pa.Array) -> pa.Array:
        m = shared.value
        if not _LAST or _LAST[0] is not m:
            _LAST[:] = m, WordTable(lambda words: word_evidence(words, m.cells)[:, None], 1)
        words, sizes = [], np.zeros(len(raw), np.int64)
        for d, t in enumerate(raw.to_pylist()):
            own = alnum_words(t)
            sizes[d] = len(own)
            words += own
        out = np.zeros(len(raw))
        full = np.flatnonzero(sizes)
        if len(full) and not m.empty:
            at = _LAST[1](words)
            top, _, _ = worst_stretch(_LAST[1].rows[at, 0].astype(np.float64), sizes[full])
            out[full] = 1 / (1 + np.exp(-np.clip(top + m.bias, -50, 50)))
        return pa.array(out)

    return judge(utf8(text))
