"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Two bag-of-n-grams models share ``CELLS`` hashed cells: one of the target texts, one of all texts. A
document's log importance weight is the sum over its n-grams of log(target / raw). Adding Gumbel noise to
the weights and keeping the k largest draws k documents without replacement in proportion to their
weights. N-grams are single tokens (runs of word characters, runs of other signs) and pairs; a token that
repeats the one before it counts as the pair "again", so that stuck text is one event, not thousands.

The raw model counts all documents, the target model at most ``TARGET_ROWS`` of those labelled good, drawn by a
hash of their ids; both in one distributed pass into a fixed number of cells. k is the expected number of target-like
documents: the sum over documents of min(1, prior * exp(log weight / sqrt(n-grams))), where prior is the share
of target among the labelled ones (1 without labels that say otherwise); the root is there because the
n-grams of one text are far from independent evidence. The k-th largest key is found by narrowing a
histogram, so nothing is sorted in one task. Noise comes from a hash of id and text: reruns agree.

Defined results: null, empty and tokenless texts have weight 1 (log 0) and compete like others; documents
whose keys tie with the k-th are all kept; repeated rows share their key; an empty table gives an empty
result; without target texts every log weight is 0 and, with prior 1, everything is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import held, mix, struct_array, unused_name, utf8, write_table

CELLS = 1 << 16
SMOOTHING = 20.0
TARGET_ROWS = 20_000
# Kinds of bytes: word characters (ASCII letters and digits, all beyond ASCII), other signs, white space.
WORD, SIGN, BLANK = range(3)
_CODES = np.arange(256)
_KINDS = np.where((_CODES >= 0x80) | np.isin(_CODES, list(b"0123456789")) | (((_CODES | 32) >= 0x61) & ((_CODES | 32) <= 0x7A)),
                  WORD, SIGN).astype(np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = BLANK
PART_BYTES = 1 << 20
AGAIN = np.uint64(0x5EED)
EXACT_KEYS = 10_000
BINS = 1_000


def ngram_cells(texts: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Cells of all tokens and token pairs, and the number of the text each belongs to, for one part of a batch
    after the other: numbers take some hundred bytes a token. numpy cuts the tokens and Arrow numbers them, so
    Python sees each distinct one of a part once.
    """
    held("quality", object)  # frees what an earlier stage kept
    texts = pc.fill_null(texts, b"")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + PART_BYTES, "right")) - 1)
        yield slice(i, j), *_part_cells(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        i = j


def _part_cells(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KINDS[data]
    begins = np.ones(len(data) + 1, bool)
    begins[1:-1] = kind[1:] != kind[:-1]
    begins[ends] = True
    first = np.flatnonzero(begins)
    places = pa.py_buffer(first.astype(np.int32))
    coded = pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, places, pa.py_buffer(data)]).dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    digests = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    first = first[:-1]
    tokens = kind[first] != BLANK
    h = digests[coded.indices.to_numpy()[tokens]]
    doc = np.searchsorted(ends, first[tokens], "right") - 1
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    pair = np.where(h[inner] == h[inner + 1], AGAIN, mix(mix(h[inner]) + h[inner + 1]))
    cells = np.concatenate((mix(h), pair)) % np.uint64(CELLS)
    return cells.astype(np.int64), np.concatenate((doc, doc[inner]))


@dataclass
class QualityModel:
    ratio: np.ndarray
    prior: float


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    rows: int = TARGET_ROWS,
) -> QualityModel:
    """Models of all texts and of those labelled 1. Ids labelled twice count by the lower label."""
    told = labels.filter(F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"))
    known = docs.select(F.col(key).alias("k")).distinct().join(told, "k")
    good, all_ = known.agg(F.count_if(F.col("y") == 1), F.count(F.lit(1))).first()
    # At most ``rows`` ids: small enough to send to every task, so no text is moved to meet its label.
    drawn = known.filter("y = 1").orderBy(F.xxhash64("k"), "k").limit(rows).select("k", F.lit(True).alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, CELLS), np.int64)
        for b in batches:
            target = np.array([bool(x) for x in b.column(1).to_pylist()], bool)
            for part, cells, doc in ngram_cells(b.column(0)):
                total[0] += np.bincount(cells, minlength=CELLS)
                total[1] += np.bincount(cells[target[part][doc]], minlength=CELLS)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(total[0, used]), pa.array(total[1, used])], names=["cell", "raw", "target"]
        )

    texts = docs.select(F.col(key).alias("k"), utf8(F.col(text)).alias("t"))
    counts = (
        texts.join(F.broadcast(drawn), "k", "left").select("t", "target")
        .mapInArrow(count, "cell long, raw long, target long")
        .groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    )
    table = np.zeros((2, CELLS))
    for r in counts:
        table[:, r.cell] = r.raw, r.target
    if not table[1].any():
        return QualityModel(np.zeros(CELLS), 1.0)
    # Against what the raw model expects of as many target n-grams: a cell with little evidence says nothing.
    expected = table[0] / table[0].sum() * table[1].sum()
    return QualityModel(np.log((table[1] + SMOOTHING) / (expected + SMOOTHING)), good / all_)


def log_weight(text: Column, model: QualityModel, spark) -> Column:
    shared = spark.sparkContext.broadcast(model.ratio)

    @F.arrow_udf("log_weight double, n_grams long")
    def weigh(raw: pa.Array) -> pa.Array:
        sums, n_grams = np.zeros(len(raw)), np.zeros(len(raw), np.int64)
        for part, cells, doc in ngram_cells(raw):
            sums[part] = np.bincount(doc, shared.value[cells], part.stop - part.start)
            n_grams[part] = np.bincount(doc, minlength=part.stop - part.start)
        return struct_array(log_weight=pa.array(sums), n_grams=pa.array(n_grams))

    return weigh(utf8(text))


def gumbel(*on: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *on), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, column: str = "key") -> float:
    """The k-th largest value of a stored column, by narrowing a histogram; -inf when k covers all."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0
    while True:
        inside = keys.filter((F.col(column) >= low) & (F.col(column) <= high))
        if low == high:
            return low
        step = (high - low) / BINS
        if inside.count() <= EXACT_KEYS or step == 0 or low + step == low:
            rows = inside.groupBy(column).count().orderBy(F.desc(column)).limit(EXACT_KEYS + 1).collect()
            for r in rows:
                above += r["count"]
                if above >= k:
                    return r[column]
        cell = F.least(F.floor((F.col(column) - low) / step), F.lit(BINS - 1))
        cells = inside.groupBy(cell.alias("c")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        ).collect()
        for r in sorted(cells, key=lambda r: -r.c):
            if above + r.n >= k:
                low, high = r.low, r.high
                break
            above += r.n


def resample(
    docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text", k: int | None = None,
    seed: int = 11,
) -> DataFrame:
    """Rows ``key``, log_weight, sample_key, kept for all of ``docs``."""
    spark = docs.sparkSession
    weighed = write_table(
        docs.select(
            F.col(key).alias("id"), log_weight(F.col(text), model, spark).alias("w"),
            gumbel(F.col(key), F.col(text), seed=seed).alias("noise"),
        ).select("id", "w.log_weight", "w.n_grams", (F.col("w.log_weight") + F.col("noise")).alias("key")),
        "quality-keys",
    )
    if k is None:
        likely = F.least(F.lit(1.0), F.lit(model.prior) * F.exp(
            F.least(F.col("log_weight") / F.sqrt(F.greatest("n_grams", F.lit(1))), F.lit(50.0))))
        k = round(weighed.agg(F.sum(likely)).first()[0] or 0.0)
    least = kth_largest(weighed, k)
    return weighed.select(
        F.col("id").alias(key), "log_weight", F.col("key").alias("sample_key"), (F.col("key") >= least).alias("kept")
    )


def good_documents(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", seed: int = 11
) -> DataFrame:
    """The rows of ``docs`` that the resampling keeps, columns as given."""
    spark = docs.sparkSession
    weight, noise = (unused_name(docs, n) for n in ("log_weight", "sample_key"))
    model = learn(docs, labels, key, text, label)
    judged = resample(docs, model, key, text, seed=seed)
    least = judged.filter("kept").agg(F.min("sample_key")).first()[0]
    if least is None:
        return docs.limit(0)
    scored = docs.withColumn(weight, log_weight(F.col(text), model, spark))
    scored = scored.withColumn(noise, F.col(weight)["log_weight"] + gumbel(F.col(key), F.col(text), seed=seed))
    return scored.filter(F.col(noise) >= least).drop(weight, noise)
