"""Near-duplicate detection with b-bit MinHash, exact links and components.

1. Every text becomes its set of five-word shingles (64-bit hashes), an exact digest of the set, a MinHash
   signature of which ``BITS`` low bits per minimum are kept and packed, and ``BANDS`` band keys. Texts with
   the same set form one class straight away; from here on there is one row per class.
2. Classes that share a band key are candidates. In each bucket the collision-corrected estimate (agreeing bits
   counted) discards pairs six standard errors below the threshold; of the rest only those leave the task that
   join something not joined yet. What they connect is a unit: every link lies in one, so a class ships
   its whole set once. Buckets with the same classes count once; those beyond ``sigtree.BLOCK`` classes go into
   one unit as they are.
3. A unit is a block, or several if it is large. A block makes the signatures again, and pairs whose estimate
   is near enough are verified on the full sets, best first, unless they are linked already. So a block gives
   fewer links than it has classes, however many pairs are near the threshold.
4. Units of several blocks: classes outside the unit's main component so far, in chunks, meet its blocks, and
   again only links leave that join something. No pair is dropped for the size of a bucket or unit.

With 32 bands of three minima a pair at similarity 0.75 shares no band with probability 3e-8, and the estimate
errs by six standard errors with 1e-9. Shingles are 64-bit hashes.

Defined results: null and wordless texts have an empty set, link with nothing and stay; texts of fewer
than five words are one shingle; rows with the same id and text are copies of each other (each has the
component id of the group and kept as the contract says); null ids count as an id above all others; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sigtree
from .text import WordHashes, gram_hashes, held, lower_space_words, mix, struct_array, unused_name, utf8, write_table

WORDS = 5
PERCENT = 75
BANDS, ROWS, BITS = 32, 3, 4
MINIMA = BANDS * ROWS
PACKED = MINIMA * BITS // 64
SLACK = 6.0
KNOWN_WORDS = 200_000

_STEPS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(raw: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    own = lower_space_words(raw)
    if not own:
        return np.zeros(0, np.uint64)
    hashes = held("minhash", lambda: WordHashes(KNOWN_WORDS))
    return np.unique(gram_hashes(hashes(own), min(words, len(own))))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row per (nonempty) set."""
    line = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), MINIMA), np.uint64)
    if len(sets):
        for k, step in enumerate(_STEPS):
            out[:, k] = np.minimum.reduceat(line * step, starts)
    return out


def packed_signatures(values: np.ndarray) -> np.ndarray:
    """``BITS`` bits of every minimum, packed into 64-bit words."""
    low = (mix(values) & np.uint64((1 << BITS) - 1)).reshape(len(values), PACKED, -1)
    return np.bitwise_or.reduce(low << (np.arange(low.shape[2], dtype=np.uint64) * np.uint64(BITS)), axis=2)


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(len(values), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = mix(mix(key) + rows[:, :, k])
    return key


LOW_BITS = np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS)))


def estimated_similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures from differing minima, corrected for chance agreement of their bits."""
    differ = many ^ one
    folded = differ.copy()
    for k in range(1, BITS):
        folded |= differ >> np.uint64(k)
    agree = 1 - np.bitwise_count(folded & LOW_BITS).sum(axis=1) / MINIMA
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def least_estimate(percent: float = PERCENT) -> float:
    j, chance = percent / 100, 2.0**-BITS
    agree = chance + (1 - chance) * j
    return j - SLACK * float(np.sqrt(agree * (1 - agree) / MINIMA)) / (1 - chance)


def describe(text: Column, words: int = WORDS) -> Column:
    """Struct n, digest, sig, bands of a text."""

    @F.arrow_udf("n long, digest binary, sig binary, bands array<long>")
    def one(raw: pa.Array) -> pa.Array:
        sets = [shingles(t, words) for t in raw.to_pylist()]
        full = [s for s in sets if len(s)]
        values = minima(full)
        sigs, bands = iter(packed_signatures(values)), iter(band_keys(values).view(np.int64))
        kinds = [(sigtree.digest_of(s), next(sigs).tobytes(), next(bands)) if len(s) else (None, None, None) for s in sets]
        return struct_array(
            n=pa.array([len(s) for s in sets], pa.int64()), digest=pa.array([k[0] for k in kinds], pa.binary()),
            sig=pa.array([k[1] for k in kinds], pa.binary()), bands=pa.array([k[2] for k in kinds], pa.list_(pa.int64())),
        )

    return one(utf8(text))


def near_pairs(
    sigs: np.ndarray, label: np.ndarray, percent: float, possible=None, similar=None
) -> list[tuple[int, int]]:
    """Pairs of different labels that join all whose estimates are near enough (and that are ``similar``).

    ``possible`` thins out the partners of one at a time before ``similar`` looks at them singly.
    """
    least, label, out = least_estimate(percent), label.copy(), []

    def join(i: int, j: int) -> None:
        if label[i] != label[j] and (similar is None or similar(i, j)):
            label[label == label[j]] = label[i]
            out.append((i, int(j)))

    # The best partner of each first: most of a group is one component before the rest is looked at.
    for best in (True, False):
        for i in range(len(sigs) - 1):
            if best or (label[i + 1 :] != label[i]).any():
                like = estimated_similarity(sigs[i], sigs[i + 1 :])
                if best:
                    near = [like.argmax()] if like.max() >= least else []
                else:
                    near = np.flatnonzero((like >= least) & (label[i + 1 :] != label[i]))
                near = np.asarray(near, np.int64) + i + 1
                for j in near if possible is None or not len(near) else possible(i, near):
                    join(i, j)
    return out


def near_links(sets: list[np.ndarray], label: np.ndarray, percent: float) -> list[tuple[int, int]]:
    """Links between sets of different labels that suffice to join all that are linked."""

    def similar(i: int, j: int) -> bool:
        if min(len(sets[i]), len(sets[j])) * 100 < percent * max(len(sets[i]), len(sets[j])):
            return False
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)

    if len(sets) < 2:
        return []
    # Bitmaps over the shingles that the block has more than once: no overlap is greater than theirs.
    known = sigtree.leaves(sets, label)

    def possible(i: int, js: np.ndarray) -> np.ndarray:
        overlap = sigtree.common_bits(known.bits, np.full(len(js), i), js) + np.minimum(known.hidden[i], known.hidden[js])
        return js[(100 + percent) * overlap >= percent * (known.least[i] + known.least[js])]

    return near_pairs(packed_signatures(minima(sets)), label, percent, possible, similar)


EDGES = pa.list_(pa.struct([("a", pa.binary()), ("b", pa.binary())]))


def as_edges(rows: list[dict], pairs: list[tuple[int, int]]) -> list[dict]:
    return [{"a": rows[i]["digest"], "b": rows[j]["digest"]} for i, j in pairs]


def met_in_bucket(slots: Column, percent: float) -> Column:
    @F.arrow_udf("array<struct<a binary, b binary>>")
    def pairs(buckets: pa.Array) -> pa.Array:
        out = []
        for rows in buckets.to_pylist():
            sigs = np.stack([np.frombuffer(r["sig"], np.uint64) for r in rows])
            out.append(as_edges(rows, near_pairs(sigs, np.arange(len(rows)), percent)))
        return pa.array(out, EDGES)

    return pairs(slots)


def links_within(slots: Column, percent: float) -> Column:
    @F.arrow_udf("array<struct<a binary, b binary>>")
    def links(blocks: pa.Array) -> pa.Array:
        out = []
        for i in range(len(blocks)):
            rows = blocks[i].as_py()
            out.append(as_edges(rows, near_links(sigtree.as_sets(rows), np.arange(len(rows)), percent)))
        return pa.array(out, EDGES)

    return links(slots)


def links_across(asking: Column, slots: Column, percent: float) -> Column:
    @F.arrow_udf("array<struct<a binary, b binary>>")
    def links(asking: pa.Array, blocks: pa.Array) -> pa.Array:
        out = []
        for i in range(len(blocks)):
            rows = list({r["digest"]: r for r in asking[i].as_py() + blocks[i].as_py()}.values())
            number: dict[bytes, int] = {}
            label = np.array([number.setdefault(r["root"], len(number)) for r in rows])
            out.append(as_edges(rows, near_links(sigtree.as_sets(rows), label, percent)))
        return pa.array(out, EDGES)

    return links(asking, slots)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: float = PERCENT, words: int = WORDS
) -> DataFrame:
    """Rows id, n_shingles, digest, component_id for all of ``docs``."""
    base = docs.select(F.col(key).alias("id"), utf8(F.col(text)).alias("raw"))
    sets = write_table(base.select("id", describe(F.col("raw"), words).alias("s")).select("id", "s.*"), "sets", "lz4")
    full = sets.filter("n > 0")
    classes = write_table(full.groupBy("digest", "n").agg(F.min("id").alias("first")), "classes", "lz4")
    # Least and greatest class of a band key differ where several have it.
    spread = full.select(F.xxhash64("digest").alias("d"), F.explode("bands").alias("token"))
    shared = spread.groupBy("token").agg(F.min("d").alias("low"), F.max("d").alias("high")).filter("low < high")
    members = full.select("digest", F.explode("bands").alias("token")).join(shared.select("token"), "token")
    kept = sigtree.distinct_buckets(write_table(members.distinct(), "members", "lz4"))
    sigs = full.select("digest", "sig").join(kept.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
    small = kept.filter(F.col("size") <= sigtree.BLOCK).join(sigs, "digest").groupBy("token").agg(
        F.collect_list(F.struct("digest", "sig")).alias("slots"))
    met = small.select(F.explode(met_in_bucket(F.col("slots"), percent)).alias("e")).select("e.*")
    edges = sigtree.linked(
        base, classes, kept.select("token", "digest"), met.unionAll(sigtree.stars(kept)).distinct(), percent, words,
        links_within, links_across)
    return _named(sets, sigtree.with_root(classes, edges, "root"))


def _named(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Every row of ``sets`` with the least id of its component."""
    ids = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.select("digest", "root").join(ids, "root").select("digest", "component_id")
    return sets.select("id", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left").withColumn(
        "component_id", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that have their component's least id, columns as given.

    Rows that repeat a kept id with the same set collapse to one of them.
    """
    spare, digest = unused_name(docs, "near_id"), unused_name(docs, "near_digest")
    own = unused_name(docs, "near_digest_kept")
    judged = near_duplicates(docs, key, text, **options)
    sets = write_table(
        judged.groupBy("id", "digest").agg(
            F.max(F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"), F.count(F.lit(1)).alias("rows")),
        "kept", "lz4")
    repeated = not sets.groupBy("id").agg(F.sum("rows").alias("rows")).filter("rows > 1").isEmpty()
    kept = sets.filter("kept").select(F.col("id").alias(spare), F.col("digest").alias(own))
    same = docs[key].eqNullSafe(kept[spare])
    if not repeated:
        return docs.join(kept, same).select(*docs.columns)
    # An id with several texts: only those whose set was kept.
    described = docs.withColumn(digest, describe(F.col(text), options.get("words", WORDS))["digest"])
    out = described.join(
        kept, described[key].eqNullSafe(kept[spare]) & described[digest].eqNullSafe(kept[own]))
    return out.dropDuplicates([key, digest]).select(*docs.columns)
