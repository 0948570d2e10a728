"""A small corpus with the awkward cases, and plain Python counterparts of the word rules."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Names that operators use inside: they must not clash.
    T.StructField("no", T.StringType()), T.StructField("id", T.LongType()), T.StructField("verdict", T.StringType()),
])


def words(rng: random.Random, n: int, base: str = "w") -> str:
    return " ".join(f"{base}{rng.randrange(400)}" for _ in range(n))


def corpus(seed: int = 1, unique: bool = True) -> list[tuple]:
    rng = random.Random(seed)
    shared = words(rng, 30, "s")
    texts: list[str | None] = [None, "", " \n\t ", "one", "two words", shared, shared, "x " * 300]
    texts += [words(rng, rng.randrange(3, 90)) for _ in range(40)]
    texts += [t + " extra" for t in texts[10:16]]
    texts += [f"{words(rng, 15)} {shared} {words(rng, 12)}" for _ in range(5)]
    texts += [words(rng, 4000), "Ünï cödé ñ 漢字 🙂 " * 8, "A\x0bB\x0cC\rD  E", texts[20], texts[20].upper()]
    rows = [(i * 3 - 6, t, "en" if i % 3 else None, (None, "b", "a", "c")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    if not unique:
        rows += [rows[12], rows[12], (rows[13][0], "another text under the same id", "en", "a", 3), (None, "no id at all", None, None, 1)]
    return [(*r, f"no{i}", i, "v") for i, r in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
