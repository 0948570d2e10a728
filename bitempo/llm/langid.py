"""Language identification of mixed texts by expectation-maximisation.

Per language a byte trigram model (each byte of a word given the two before it, word ends included) gives
every word a likelihood. A document is a mixture: its language shares are estimated by EM over the words,
for the whole set of languages first, then for its strongest one, two, ... up to all languages; the set with the
best penalised likelihood is kept. Larger sets are left out only where their penalty alone loses. Learning reads all labelled documents in one distributed count into a fixed
number of cells per language; inference is an Arrow function on the text column, without a shuffle.

Defined results: a null, empty or letterless text is ``und`` with score 0; without any labelled text
everything is ``und``; documents with a null language teach nothing; ties go to the language that sorts
first; repeated rows are judged alike.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WordTable, alnum_words, byte_grams, utf8

CELLS = 1 << 17
SMOOTHING = 5.0
ITERATIONS = 12
PENALTY = 4.0
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    whole: np.ndarray     # (CELLS, languages): log probability weight of a trigram
    context: np.ndarray   # (CELLS, languages): log weight of its first two bytes


def _cells(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    grams, owner = byte_grams(words, (n,))
    return (grams % np.uint64(CELLS)).astype(np.int64), owner


def learn(docs: DataFrame, text: str = "text", language: str = "lang") -> LanguageModel:
    """Trigram and bigram counts per language over all rows with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], np.ndarray] = defaultdict(lambda: np.zeros(CELLS))
        for b in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words[name].update(alnum_words(raw))
            for name, seen in words.items():
                if not seen:
                    continue
                own, times = list(seen), np.fromiter(seen.values(), np.float64, len(seen))
                for n in (2, 3):
                    cell, owner = _cells(own, n)
                    counts[name, n] += np.bincount(cell, times[owner], CELLS)
        for (name, n), c in counts.items():
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used)), pa.array([n] * len(used), pa.int64()), pa.array(used),
                 pa.array(c[used].astype(np.int64))],
                names=["lang", "n", "cell", "times"],
            )

    known = docs.filter(F.col(language).isNotNull()).select(F.col(language).cast("string"), utf8(F.col(text)))
    total = (
        known.mapInArrow(count, "lang string, n long, cell long, times long")
        .groupBy("lang", "n", "cell").agg(F.sum("times").alias("times")).toPandas()
    )
    languages = sorted(total["lang"].unique())
    tables = {n: np.zeros((CELLS, len(languages)), np.float64) for n in (2, 3)}
    number = {name: i for i, name in enumerate(languages)}
    for n, table in tables.items():
        part = total[total["n"] == n]
        table[part["cell"].to_numpy(), part["lang"].map(number).to_numpy(np.int64)] = part["times"].to_numpy()
    # Trigram given its bigram, smoothed towards an even spread over 64 next bytes.
    return LanguageModel(
        languages, np.log(tables[3] + SMOOTHING / 64).astype(np.float32),
        np.log(tables[2] + SMOOTHING).astype(np.float32),
    )


def word_likelihoods(words: list[bytes], model: LanguageModel) -> np.ndarray:
    """Log likelihood per language; the last column tells whether the word has a letter."""
    out = np.zeros((len(words), len(model.languages) + 1), np.float32)
    cells, owner = _cells(words, 3)
    two, two_owner = _cells(words, 2)
    for k in range(len(model.languages)):
        out[:, k] = np.bincount(owner, model.whole[cells, k], len(words))
        # Every trigram of a word has a bigram before it: all bigrams of the word but the last.
        last = np.cumsum(np.bincount(two_owner, minlength=len(words))) - 1
        before = model.context[two, k].astype(np.float64)
        out[:, k] -= np.bincount(two_owner, before, len(words)) - before[last]
    out[:, -1] = [w[:1].isalpha() or any(map(str.isalpha, w.decode("utf-8", "replace"))) for w in words]
    return out


def mixture(like: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, iterations: int = ITERATIONS):
    """EM shares per document (languages not in ``allowed`` stay 0), and the log likelihood reached.

    ``like``: likelihood of each word, scaled to a maximum of 1 (the scale drops out of comparisons);
    documents stand one after the other with ``sizes`` words, none of them empty.
    """
    starts = np.cumsum(sizes) - sizes
    shares = (allowed / allowed.sum(axis=1, keepdims=True)).astype(like.dtype)
    for i in range(iterations + 1):
        joint = np.repeat(shares, sizes, axis=0) * like
        total = np.maximum(reduce(np.add, joint.T), 1e-30)
        if i == iterations:
            return shares, np.add.reduceat(np.log(total), starts, dtype=np.float64)
        shares = np.add.reduceat(joint / total[:, None], starts, axis=0) / sizes[:, None].astype(like.dtype)


def infer(texts: list[bytes | None], table: WordTable, languages: int):
    """Shares per document of the selected languages, and whether the document has a letter.

    No mixture can explain a document better than every word's own best language does. Where a single
    language comes as close to that as the penalty for a second one, it has won, and EM is left out.
    """
    n = len(texts)
    words, sizes = [], np.zeros(n, np.int64)
    for d, raw in enumerate(texts):
        own = alnum_words(raw)
        sizes[d] = len(own)
        words += own
    at = table(words)
    rows = table.rows[at]
    letters = rows[:, -1] > 0
    counted = np.bincount(np.repeat(np.arange(n), sizes)[letters], minlength=n)
    logs = rows[letters, :-1]
    best = np.zeros((n, languages))
    full = np.flatnonzero(counted)
    if not len(full):
        return best, counted > 0
    sizes = counted[full]
    below = logs - reduce(np.maximum, logs.T)[:, None]
    alone = np.add.reduceat(below, np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
    best[full, alone.argmax(axis=1)] = 1.0
    value = alone.max(axis=1)
    price = PENALTY * np.log(np.maximum(sizes, 2))
    open_ = value < -price
    if languages > 1 and open_.any():
        like = np.exp(np.maximum(below[np.repeat(open_, sizes)], -60.0))
        sizes, value, price = sizes[open_], value[open_], price[open_]
        shares, _ = mixture(like, sizes, np.ones((len(sizes), languages)))
        rank = np.argsort(np.argsort(-shares, axis=1, kind="stable"), axis=1, kind="stable")
        chosen = best[full[open_]]
        for k in range(2, languages + 1):
            # No fit is above 0: where the price of k languages is below the value so far, no larger set wins.
            still = np.flatnonzero(value < -price * (k - 1))
            if not len(still):
                break
            part = np.repeat(value < -price * (k - 1), sizes)
            own, fit = mixture(like[part], sizes[still], (rank[still] < k).astype(float))
            fit -= price[still] * (k - 1)
            better = fit > value[still]
            chosen[still[better]], value[still[better]] = own[better], fit[better]
        best[full[open_]] = chosen
    return best, counted > 0


# A worker keeps the words of the model it used last.
_LAST: list = []


def predict(text: Column, model: LanguageModel, spark) -> Column:
    """Struct lang_pred, score (its share), languages (all selected) of a text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, languages array<string>")
    def judge(raw: pa.Array) -> pa.Array:
        m = shared.value
        if not _LAST or _LAST[0] is not m:
            _LAST[:] = m, WordTable(lambda words: word_likelihoods(words, m), len(m.languages) + 1)
        texts = raw.to_pylist()
        if not m.languages:
            return pa.array([{"lang_pred": UNKNOWN, "score": 0.0, "languages": []}] * len(texts), KIND)
        shares, known = infer(texts, _LAST[1], len(m.languages))
        top = shares.argmax(axis=1)
        return pa.array([
            {"lang_pred": m.languages[t], "score": float(min(1.0, row[t])),
             "languages": [m.languages[k] for k in np.flatnonzero(row > 0)]} if ok
            else {"lang_pred": UNKNOWN, "score": 0.0, "languages": []}
            for row, t, ok in zip(shares, top, known)
        ], KIND)

    return judge(utf8(text))


KIND = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string()))])
