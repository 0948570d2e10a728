"""Token files: canonical length-limited Huffman coding of token ids.

Documents are range-partitioned by id and tokenised once; the ids are written as a table in document
order. Global counts of the ids (one row per vocabulary entry) give code lengths by package-merge, and
lengths alone define the canonical code. Ids are then coded in independent blocks of whole documents. A
block has a bit offset for every ``STRIDE`` ids, so a reader starts at any of them and decodes all of
them side by side, one table look-up per id.

A token file is a folder: ``codes`` (token, length) and ``blocks`` (one folder per range of documents in
ascending order; in it rows in ascending order of ``first``, with doc ids, ids per document, bit
offsets and the coded bits), all in Parquet, so any Spark reader can open, prune and split it.

Defined results: a null text counts as empty (only the end id); documents with the same id stand in the
order of their texts; an empty table gives a file without blocks; null doc ids come first and stay null.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_dir
from .text import held, write_table

END_ID = 2
MAX_LENGTH = 20
STRIDE = 128
BLOCK_IDS = 1 << 18
PIECES_KEPT = 300_000
PART_BYTES = 3 << 20
JOINED = 400
LINES = 32
COUNTED = 1 << 18

# The byte-level pattern is  's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?P+|\s+(?!\S)|\s+  with L letters, N numbers and P
# other signs. Kinds of bytes for it: those, the apostrophe Q, signs Y that are no white space and otherwise
# unknown, the blank S, other white space W of ASCII, and Z for what may be white space.
L, N, P, Q, Y, S, W, Z = range(8)
_KINDS = np.full(256, P, np.uint8)
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = L
_KINDS[0x30:0x3A] = N
_KINDS[0x27] = Q
_KINDS[0x80:] = Y
_KINDS[0x20] = S
_KINDS[0x09:0x0E] = W
_KINDS[0x1C:0x20] = Z
# First bytes of nothing but letters, but for the two signs in SIGNS: Latin, Cyrillic, Chinese, Korean.
_KINDS[[*range(0xC3, 0xC8), 0xD0, 0xD1, *range(0xE5, 0xE9), 0xEB, 0xEC]] = L
SIGNS = (0xC397, 0xC3B7)
# First bytes of white space beyond ASCII and of signs that are taken for it here and there; their second ones.
BLANKS = {0xC2: (0x85, 0xA0), 0xE1: (0x9A, 0xA0), 0xE2: (0x80, 0x81), 0xE3: (0x80,), 0xEF: (0xBB,)}
# Between which kinds no match of the pattern goes on, and where only if white space is a single sign.
_CUT, _CUT_AFTER_ONE = np.zeros(64, bool), np.zeros(64, bool)
_CUT[[8 * a + b for a in (L, N, P, Q, Y) for b in (S, W)]] = True
_CUT[[8 * a + b for a, b in ((L, N), (L, P), (L, Q), (N, L), (N, P), (N, Q), (P, L), (P, N), (Q, N))]] = True
_CUT_AFTER_ONE[[8 * W + b for b in (L, N, P, Q, Y)]] = True
# Pieces that can stand on a line of their own (for Arrow's regular expressions).
PLAIN = r"^ ?[^\s\x0b\x1c-\x1f\x{85}\pZ\x{180e}\x{200b}-\x{200f}\x{feff}]+$"


def strings(keys: pa.Array) -> list[str]:
    return keys.to_numpy(zero_copy_only=False).tolist()


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of every byte of UTF-8 texts; bytes of a character are of one kind."""
    out = _KINDS[data]
    more = np.flatnonzero(data >= 0x80)
    if not len(more):
        return out
    lead = more[data[more] >= 0xC0]
    first, second = data[lead], data[lead + 1]
    pair = first.astype(np.int64) << 8 | second
    out[lead[np.isin(pair, SIGNS)]] = Y
    out[lead[np.isin(pair, [a << 8 | b for a, own in BLANKS.items() for b in own])]] = Z
    later = more[data[more] < 0xC0]
    for _ in range(3):
        out[later] = out[later - 1]
    return out


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin that lie one after the other; ``ends``: of the texts."""
    kind = kinds(data)
    pair = kind[:-1] << 3 | kind[1:]
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = _CUT[pair]
    begins[0] = begins[ends] = True
    begins[1:-1] |= _CUT_AFTER_ONE[pair] & begins[:-2]
    return np.flatnonzero(begins[:-1])


class PieceEncoder:
    """Encodes texts piece by piece and remembers the ids of pieces.

    Texts are cut where no match of the byte-level pattern goes on whatever stands around (``cuts``), so the pieces
    have the same ids one by one as in one go. Words and the signs after them are pieces of their own. numpy cuts
    and Arrow numbers the pieces, so Python sees each distinct piece of a batch once.

    Pieces not seen before go to the tokenizer many at a time, a line each: a line end is a token of its own
    before a piece. When too many are known, those of the last batch stay. Texts that may hold an added token,
    and all texts of a tokenizer with another pattern, are encoded whole.
    """

    def __init__(self, definition: str):
        import json

        from tokenizers import Tokenizer

        # A task has one core, and every thread of the library would keep memory of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.line_end = self.one("\n")
        pattern = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.cuts = (
            pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True)
            and not pattern.get("add_prefix_space") and not self.tokenizer.normalizer
            and all(t.content.startswith("<|") for t in added)
        )
        self.forget()

    def one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.start = np.zeros(PIECES_KEPT, np.int32)
        self.size = np.zeros(PIECES_KEPT, np.int32)
        self.used = 0
        self.recent = np.zeros(0, np.int64)

    def keep_recent(self) -> None:
        """Forget all pieces but those of the last batch."""
        keys = list(self.known)  # in the order of their numbers
        keys = [keys[i] for i in self.recent]
        sizes = self.size[self.recent]
        ids = self.ids_of(self.recent)
        self.forget()
        self.add(keys, ids, sizes, np.cumsum(sizes) - sizes)

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these pieces, one after the other."""
        size = self.size[numbers]
        shift = self.start[numbers] - (np.cumsum(size, dtype=np.int32) - size)
        at = np.repeat(shift, size)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at]

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> None:
        k, n = len(self.known), len(keys)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while k + n > len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + n], self.size[k : k + n] = self.used + starts, sizes
        self.used += len(ids)
        self.known.update(zip(keys, range(k, k + n)))

    def learn(self, keys: pa.Array) -> None:
        """Encode new distinct pieces."""
        plain = pc.match_substring_regex(keys, PLAIN)
        if len(self.line_end) != 1:
            plain = pc.and_(plain, False)
        for key in keys.filter(pc.invert(plain)).to_pylist():
            ids = np.asarray(self.one(key), np.uint32)
            self.add([key], ids, np.array([len(ids)]), np.array([0]))
        keys = keys.filter(plain)
        if not len(keys):
            return
        places = pa.array(np.append(np.arange(0, len(keys), JOINED), len(keys)), pa.int32())
        lines = pc.binary_join(pa.ListArray.from_arrays(places, keys), "\n").to_pylist()
        found = []
        # Encodings hold much more than ids: a few at a time.
        for i in range(0, len(lines), LINES):
            for encoding in self.tokenizer.encode_batch_fast(lines[i : i + LINES], add_special_tokens=False):
                found += [np.asarray(encoding.ids, np.uint32), np.asarray(self.line_end, np.uint32)]
        ids = np.concatenate(found)
        ends = np.flatnonzero(ids == self.line_end[0])
        if len(ends) != len(keys):
            raise ValueError("this tokenizer does not keep a line end apart")
        starts = np.concatenate(([0], ends[:-1] + 1))
        self.add(strings(keys), ids, ends - starts, starts)

    def numbers(self, keys: pa.Array) -> np.ndarray:
        """Piece numbers of distinct pieces, new ones learned first."""
        own = strings(keys)
        places = np.fromiter(map(self.known.get, own, repeat(-1)), np.int64, len(own))
        fresh = np.flatnonzero(places < 0)
        if len(fresh):
            self.learn(keys.take(pa.array(fresh)))
            places[fresh] = [self.known[own[i]] for i in fresh]
        return places

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in one line, and how many each has."""
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        begins = cuts(data, ends[1:])
        places = pa.py_buffer(np.append(begins, len(data)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.string(), len(begins), [None, places, pa.py_buffer(data)]).dictionary_encode()
        self.recent = self.numbers(coded.dictionary)
        number = self.recent[coded.indices.to_numpy()]
        before = np.concatenate(([0], np.cumsum(self.size[number], dtype=np.int64)))
        return self.ids_of(number), np.diff(before[np.searchsorted(begins, ends)])

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one line (each with the end id, if one is given), and how many each has.

        A batch goes in parts: numbers take some ten bytes for each of the text.
        """
        if texts.nbytes > PART_BYTES and len(texts) > 1:
            half = len(texts) // 2
            parts = [self.encode(texts.slice(0, half), end_id), self.encode(texts.slice(half), end_id)]
            return tuple(np.concatenate(x) for x in zip(*parts))
        if len(self.known) > PIECES_KEPT:
            self.keep_recent()
        n = len(texts)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False) if self.cuts else np.ones(n, bool)
        cut = np.flatnonzero(~whole)
        line, size = self.pieces(texts if len(cut) == n else texts.take(pa.array(cut)))
        lines, sizes, owner = [line], [size], [cut]
        for i in np.flatnonzero(whole):
            ids = np.asarray(self.one(texts[i].as_py()), np.uint32)
            lines.append(ids)
            sizes.append(np.array([len(ids)]))
            owner.append(np.array([i]))
        line, size, owner = np.concatenate(lines), np.concatenate(sizes), np.concatenate(owner)
        more = 0 if end_id is None else 1
        total = np.full(n, more, np.int64)
        total[owner] += size
        start = np.cumsum(total) - total
        out = np.empty(int(total.sum()), np.uint32)
        at = np.repeat(start[owner] - (np.cumsum(size) - size), size)
        at += np.arange(len(line))
        out[at] = line
        if more:
            out[start + total - 1] = end_id
        return out, total

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        line, sizes = self.encode(pa.array(texts, pa.string()))
        return np.split(line, np.cumsum(sizes)[:-1]) if texts else []


def encoder(definition: str) -> PieceEncoder:
    return held(f"encoder {definition}", lambda: PieceEncoder(definition))


def token_ids(text: Column, definition, end_id: int = END_ID) -> Column:
    """Ids of a text with the end id, as little-endian 16- or 32-bit integers (``definition``: broadcast)."""

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        text, kind = definition.value
        line, sizes = encoder(text).encode(texts, end_id)
        line = line.astype(kind)
        offsets = (np.concatenate(([0], np.cumsum(sizes))) * line.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(line)])

    return ids(text.cast("string"))


# ---- code lengths and codes


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits, by package-merge; 0: not used."""
    used = np.flatnonzero(counts > 0)
    lengths = np.zeros(len(counts), np.int64)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    by_count = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[by_count].astype(np.float64)
    rows, weights = [], leaves
    is_leaf = np.ones(n, bool)
    for _ in range(limit):
        rows.append(is_leaf)
        packages = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, packages))
        order = np.argsort(both, kind="stable")
        weights, is_leaf = both[order], order < n
    take = 2 * n - 2
    for is_leaf in reversed(rows):
        own = int(is_leaf[:take].sum())
        lengths[by_count[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in code order (by length, then id), and the code of every token."""
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    sizes = lengths[order]
    longest = int(sizes[-1]) if len(sizes) else 0
    # On a scale of 2**longest each code starts where the one before it ends.
    width = np.left_shift(1, longest - sizes)
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (np.cumsum(width) - width) >> (longest - sizes)
    return order, codes


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The coded bits in big-endian 32-bit words, and the bit offset of every ``STRIDE``-th id."""
    sizes = lengths[ids]
    ends = np.cumsum(sizes)
    at = ends - sizes
    word, shift = at >> 5, at & 31
    spread = codes[ids] << (64 - shift - sizes).astype(np.uint64)
    out = np.zeros((int(ends[-1]) >> 5) + 2 if len(ids) else 0, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[first]] |= np.bitwise_or.reduceat(spread >> np.uint64(32), first)
        out[word[first] + 1] |= np.bitwise_or.reduceat(spread & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes(), at[::STRIDE]


class Decoder:
    """A table with one entry for every possible next ``longest`` bits."""

    def __init__(self, lengths: np.ndarray):
        order, _ = canonical_codes(lengths)
        sizes = lengths[order]
        self.longest = int(sizes[-1]) if len(sizes) else 0
        span = np.left_shift(1, self.longest - sizes)
        free = (1 << self.longest) - int(span.sum())  # only where a single id is in use
        self.token = np.concatenate((np.repeat(order, span), np.zeros(free, np.int64))).astype(np.uint32)
        self.length = np.concatenate((np.repeat(sizes, span), np.ones(free, np.int64))).astype(np.int64)

    def decode(self, payload: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        words = np.frombuffer(payload, ">u4").astype(np.uint64)
        words = np.concatenate((words, np.zeros(STRIDE * self.longest // 32 + 3, np.uint64)))
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at = np.asarray(offsets, np.int64).copy()
        out = np.empty((STRIDE, len(at)), np.uint32)
        drop = np.uint64(64 - self.longest)
        for k in range(min(STRIDE, n)):
            seen = ((pairs[at >> 5] << (at & 31).astype(np.uint64)) >> drop).astype(np.int64)
            out[k] = self.token[seen]
            at += self.length[seen]
        return out.T.reshape(-1)[:n]


# ---- the jobs


def tokenize(
    docs: DataFrame, definition: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID
) -> DataFrame:
    """Table (place, doc_id, ids): all documents in ascending order; ``place`` grows along it."""
    import json

    spark = docs.sparkSession
    most = max([*json.loads(definition)["model"]["vocab"].values(), end_id])
    shared = spark.sparkContext.broadcast((definition, "<u2" if most < 1 << 16 else "<u4"))
    ordered = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", "text")
    ids = ordered.select("doc_id", token_ids(F.col("text"), shared, end_id).alias("ids"))
    return write_table(ids.select(F.monotonically_increasing_id().alias("place"), "doc_id", "ids"), "token-ids")


def id_counts(tokens: DataFrame, kind: str) -> dict[int, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            raw = b.column(0)
            if not len(raw):
                continue
            # The ids of a batch lie one after the other; counting takes eight bytes an id, so it goes in parts.
            ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
            ids = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)
            for i in range(0, len(ids), COUNTED):
                more = np.bincount(ids[i : i + COUNTED], minlength=len(total))
                more[: len(total)] += total
                total = more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["token", "n"])

    counts = tokens.select("ids").mapInArrow(count, "token long, n long")
    return {r.token: r.n for r in counts.groupBy("token").agg(F.sum("n").alias("n")).collect()}


BLOCK = (
    "shard long, first long, doc_ids array<long>, n_tokens array<int>, n_ids long, offsets array<long>,"
    " bits binary"
)


def write_tokens(
    docs: DataFrame, path: str, definition: str, key: str = "doc_id", text: str = "text",
    end_id: int = END_ID, max_length: int = MAX_LENGTH,
) -> None:
    """Encode ``docs`` and write them as a token file under ``path``."""
    import json

    spark = docs.sparkSession
    most = max([*json.loads(definition)["model"]["vocab"].values(), end_id])
    kind = "<u2" if most < 1 << 16 else "<u4"
    tokens = tokenize(docs, definition, key, text, end_id)
    counts = np.zeros(most + 1, np.int64)
    for token, n in id_counts(tokens, kind).items():
        counts[token] = n
    lengths = code_lengths(counts, max_length)
    spark.createDataFrame(
        [(int(t), int(lengths[t])) for t in np.flatnonzero(lengths)], "token long, length long"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast((canonical_codes(lengths)[1], lengths))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes = shared.value
        for b in batches:
            place, doc, raw = (c.to_pylist() for c in b.columns)
            ids = [np.frombuffer(x, kind) for x in raw]
            i = 0
            while i < len(ids):
                j, n = i, 0
                while j < len(ids) and (j == i or n + len(ids[j]) <= BLOCK_IDS) and place[j] >> 33 == place[i] >> 33:
                    n += len(ids[j])
                    j += 1
                bits, offsets = encode_bits(np.concatenate(ids[i:j]).astype(np.int64), codes, sizes)
                yield pa.RecordBatch.from_pylist([{
                    "shard": place[i] >> 33, "first": place[i], "doc_ids": doc[i:j],
                    "n_tokens": [len(x) for x in ids[i:j]], "n_ids": n, "offsets": offsets.tolist(), "bits": bits,
                }], schema=BLOCK_ARROW)
                i = j

    (
        tokens.mapInArrow(blocks, BLOCK).sortWithinPartitions("shard", "first")
        .write.mode("overwrite").option("compression", "none").partitionBy("shard").parquet(f"{path}/blocks")
    )


BLOCK_ARROW = pa.schema([
    ("shard", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("n_tokens", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("offsets", pa.list_(pa.int64())),
    ("bits", pa.binary()),
])


def read_tokens(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids_crc32 of a token file; ``digest=False``: ids instead of the crc."""
    codes = spark.read.parquet(f"{path}/codes").collect()
    lengths = np.zeros(max((r.token for r in codes), default=0) + 1, np.int64)
    for r in codes:
        lengths[r.token] = r.length
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                ids = decoder.decode(row["bits"], row["offsets"], row["n_ids"])
                sizes = np.asarray(row["n_tokens"], np.int64)
                ends = np.cumsum(sizes)
                parts = [ids[e - s : e].astype("<u4").tobytes() for s, e in zip(sizes, ends)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * len(sizes), pa.int64()), pa.array([row["first"]] * len(sizes), pa.int64()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(ends - sizes), pa.array(sizes),
                    pa.array([zlib.crc32(x) for x in parts], pa.int64()) if digest else pa.array(parts, pa.binary()),
                ], names=["shard", "first", "doc_id", "within", "n_tokens", "ids_crc32" if digest else "ids"])

    # Ids before a block: those of earlier shards (one row per shard) and of earlier blocks of its own.
    index = blocks.select("shard", "first", "n_ids")
    earlier = Window.orderBy("shard")
    shards = index.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", (F.sum("n").over(earlier) - F.col("n")).alias("before")
    )
    inside = Window.partitionBy("shard").orderBy("first")
    base = index.join(shards, "shard").select(
        "shard", "first", (F.col("before") + F.sum("n_ids").over(inside) - F.col("n_ids")).alias("base")
    )
    last = "ids_crc32 long" if digest else "ids binary"
    rows = blocks.mapInArrow(decode, f"shard long, first long, doc_id long, within long, n_tokens long, {last}")
    return rows.join(base, ["shard", "first"]).select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", last.split()[0]
    )


def token_file(docs: DataFrame, definition: str, **options) -> tuple[str, DataFrame]:
    """Write ``docs`` to a fresh token file and read it back."""
    path = shared_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, definition, **options)
    return path, read_tokens(docs.sparkSession, path)
