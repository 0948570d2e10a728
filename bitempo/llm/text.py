"""Words, documents and small helpers that the text operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir

# Words between ASCII white space, and words of letters, digits and everything beyond ASCII.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"
ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_CODES = np.arange(256)
_IS_UPPER = (_CODES >= 0x41) & (_CODES <= 0x5A)
_LOWERED = np.where(_IS_UPPER, _CODES + 32, _CODES).astype(np.uint8)
_IS_WORD = ((_LOWERED >= 0x30) & (_LOWERED <= 0x39)) | ((_LOWERED >= 0x61) & (_LOWERED <= 0x7A))
LOWER_BYTES = _LOWERED.tobytes()
# A-Z lowered, every ASCII byte outside a word a blank; bytes of multi-byte characters stay.
ALNUM_BYTES = np.where(_IS_WORD | (_CODES >= 0x80), _LOWERED, 0x20).astype(np.uint8).tobytes()

# Arrow batches: long texts make a batch full before its rows do.
BATCH_ROWS, BATCH_BYTES = 4_000, 8 << 20


def space_words(raw: bytes | None) -> list[bytes]:
    """``SPACE_WORDS`` of UTF-8 bytes (``bytes.split`` cuts at the same six characters)."""
    return raw.split() if raw else []


def lower_space_words(raw: bytes | None) -> list[bytes]:
    return raw.translate(LOWER_BYTES).split() if raw else []


def alnum_words(raw: bytes | None) -> list[bytes]:
    """``ALNUM_WORDS`` after lower-casing A-Z."""
    return raw.translate(ALNUM_BYTES).split() if raw else []


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def utf8(text: Column) -> Column:
    return text.cast("string").cast("binary")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch brings into a Python worker, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def unused_name(df: DataFrame, stem: str) -> str:
    """A column name that clashes with none of the frame's."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def write_table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read back: a restart point that outlives any executor."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(StructType(df.schema.fields)).parquet(path)


class WordHashes:
    """64-bit hashes of words, each distinct word hashed once; forgotten when it grows too large."""

    def __init__(self, limit: int = 1_000_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        known, digest = self.known, xxhash.xxh64_intdigest
        for w in set(words).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_HELD: dict = {}


def _return_memory() -> None:
    """Give freed memory back to the system, where the C library can (glibc); else it stays with the worker."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def held(owner: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps between its tasks, for one owner at a time.

    Spark uses a worker again for the next stage. What the stage before it kept is freed when another owner
    asks, so a chain of stages needs the memory of its largest one and not of all together.
    """
    if owner not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _return_memory()
        _HELD[owner] = make()
    return _HELD[owner]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (two multiply and shift rounds)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hashes of every run of ``n`` consecutive word hashes."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mix(out) + h[i : len(h) - n + 1 + i]
    return mix(out)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and place within the row of each element of rows with these lengths."""
    lengths = np.asarray(lengths, np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    return rows, np.arange(len(rows)) - starts[rows]


def struct_array(**columns: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def byte_grams(words: list[bytes], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte n-grams of ``<word>``, and the number of the word each belongs to."""
    line = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word, place = ragged(lengths)
    left = lengths[word] - place
    grams, owners = [], []
    for n in sizes:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + line[at + k]
        grams.append(mix(h))
        owners.append(word[at])
    return np.concatenate(grams), np.concatenate(owners)


class WordTable:
    """Rows of numbers for words, worked out once per distinct word and batch-wise."""

    def __init__(self, compute, width: int, limit: int = 600_000):
        self.compute, self.limit, self.width = compute, limit, width
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((1 << 12, width), np.float32)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Row numbers in ``rows`` of these words."""
        places = list(map(self.known.get, words))
        if None in places:
            if len(self.known) > self.limit:
                self.known.clear()
            fresh = list(set(words).difference(self.known))
            n = len(self.known)
            while n + len(fresh) > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.rows[n : n + len(fresh)] = self.compute(fresh)
            self.known.update(zip(fresh, range(n, n + len(fresh))))
            places = map(self.known.__getitem__, words)
        return np.fromiter(places, np.int64, len(words))


def drop_table(df: DataFrame) -> None:
    """Remove a table that ``write_table`` made, and let the files of finished shuffles go with it."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release_shuffles(spark: SparkSession) -> None:
    """Shuffle files live until the driver collects the plans that made them: collect now."""
    spark.sparkContext._jvm.System.gc()
