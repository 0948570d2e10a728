"""I-Match document fingerprints, in DataFrame functions only.

Terms whose document frequency lies inside a band (their inverse document frequency is neither that of
function words nor that of one-off strings) form the lexicon. Document frequency counts distinct texts: a text
copied into a large share of the rows is one text, and its terms stay. (Near copies are different texts and
count each.) A document's distinct lexicon terms are hashed
as a set: once for the whole lexicon, and once for each of several randomised subsets of it, of which
``SUBSETS`` keep a quarter of the terms, as many a sixteenth, and so on, so that long and short documents
both have subsets that catch a few of their terms. Two fingerprints are alike to the degree that subset
hashes agree at the density where they agree best. A set is hashed by combining (exclusive or) the 64-bit
hashes of its distinct terms, which gives what hashing the sorted list gives and needs no list: terms of a document
are never brought together, each map task reduces its documents to one row.

The lexicon is bounded whatever the corpus: a text has some number of distinct terms on average, and at
most that number divided by ``LEAST_SHARE`` terms can each be in so large a share of all distinct texts. It is
broadcast on that ground.

Documents follow each other in the order of (id, hash of the text), null ids first. Defined results: a null text counts as
empty; a text without terms has the fingerprint of the empty set, alike (1) only to its equals; a text
none of whose terms is in the lexicon is hashed over all its terms; rows that agree in id and text are one
document with a result row each; a single document follows itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .licenses import license_words
from .text import release_shuffles, write_table

LEAST_SHARE, MOST_SHARE = 0.0005, 0.02
LEAST_DOCUMENTS = 2
SUBSETS, DENSITIES = 8, 5
FEW = 4  # subsets that must hold a term before agreement counts in full
# A document: its id with the least number for null, and a hash of its text and of whether the id is null.
# Neither is null, so joins are plain equalities that a partitioning by the key serves.
KEY = ["k", "h"]
NO_ID = -(1 << 63)


def terms(text: Column) -> Column:
    """Hashes of a text's distinct terms, one row each; one null row for a text without terms."""
    return F.explode_outer(F.transform(F.array_distinct(license_words(text)), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Term hashes inside the band of document frequencies over distinct texts."""
    each = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    n = each.select("h").distinct().count()
    low, high = max(LEAST_DOCUMENTS, least * n), max(LEAST_DOCUMENTS, most * n)
    # Copies are merged in the map tasks already, so a large group of them meets in no task.
    distinct = each.groupBy("h").agg(F.first("t").alias("t"))
    return (
        distinct.select(terms(F.col("t")).alias("term")).filter("term IS NOT NULL")
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        .filter((F.col("df") >= low) & (F.col("df") <= high)).select("term")
    )


def fingerprints(texts: DataFrame, text: str, lexicon: DataFrame, keep: list[str]) -> DataFrame:
    """Rows ``keep`` and ``prints``: an array of 32-bit numbers, whole lexicon first, then subset by subset."""
    known = lexicon.select(F.col("term").alias("known"))
    rows = texts.select(*keep, terms(F.col(text)).alias("term")).join(
        F.broadcast(known), F.col("term") == F.col("known"), "left")
    drawn = rows.select(
        *keep, "term", "known", *(F.xxhash64("known", F.lit(r)).alias(f"u{r}") for r in range(SUBSETS))
    )

    def digest(condition: Column | None, of: str = "known") -> Column:
        value = F.col(of) if condition is None else F.when(condition, F.col(of))
        return F.coalesce(F.bit_xor(value), F.lit(0))

    parts = {"whole": digest(None), "all": digest(None, "term")} | {
        f"d{j}r{r}": digest(F.col(f"u{r}").bitwiseAND(4 ** (j + 1) - 1) == 0)
        for j in range(DENSITIES) for r in range(SUBSETS)
    }
    hashed = drawn.groupBy(*keep).agg(*(c.alias(n) for n, c in parts.items()))
    # Sixty-four bits folded to thirty-two; 0 stays the mark of an empty subset.
    fold = lambda c: c.bitwiseXOR(F.shiftrightunsigned(c, 32)).bitwiseAND(0xFFFFFFFF).cast("long")
    first = F.when(F.col("whole") != 0, F.col("whole")).otherwise(F.col("all"))
    return hashed.select(*keep, F.array(
        fold(first), *(fold(F.col(n)) for n in parts if n not in ("whole", "all"))).alias("prints"))


def as_string(prints: Column) -> Column:
    return F.lower(F.array_join(F.transform(prints, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Best share, over the densities, of subsets whose hashes agree among those that hold a term of either."""
    shares = []
    for j in range(DENSITIES):
        x, y = (F.slice(c, 2 + j * SUBSETS, SUBSETS) for c in (a, b))
        same = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p == q) & (p != 0)), lambda t: t))
        held = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p != 0) | (q != 0)), lambda t: t))
        shares.append(same / F.greatest(held, F.lit(FEW)))
    return F.when(a == b, 1.0).otherwise(F.greatest(*shares)).cast("double")


def in_order(docs: DataFrame) -> DataFrame:
    """Distinct keys with id, rows, n_chars and the key that follows; the last is followed by the first."""
    distinct = docs.groupBy(*KEY).agg(
        F.max("id").alias("id"), F.count(F.lit(1)).alias("rows"), F.max("n_chars").alias("n_chars"))
    line = write_table(
        distinct.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
        .withColumn("place", F.monotonically_increasing_id()), "line",
    ).withColumn("part", F.shiftrightunsigned("place", 33))
    within = Window.partitionBy("part").orderBy("place")
    key = F.struct(*KEY)
    parts = line.groupBy("part").agg(F.min_by(key, "place").alias("start"))
    # One row per range partition: the start of the next one, or of the first after the last.
    chain = parts.select("part", F.coalesce(
        F.lead("start").over(Window.orderBy("part")),
        F.first("start").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))).alias("after"))
    followed = line.withColumn("next", F.lead(key).over(within)).join(chain, "part")
    return write_table(
        followed.withColumn("next", F.coalesce("next", "after")).select(
            *KEY, "id", "rows", "n_chars", F.col("next.k").alias("next_k"), F.col("next.h").alias("next_h")), "order")


def same_key(a: DataFrame, b: DataFrame, left=KEY, right=KEY) -> Column:
    return (a[left[0]] == b[right[0]]) & (a[left[1]] == b[right[1]])


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next."""
    base = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    base = base.withColumns({
        "k": F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)), "h": F.xxhash64("text", F.col("id").isNull())})
    words = write_table(lexicon(base, "text"), "lexicon")
    release_shuffles(docs.sparkSession)
    order = in_order(base.select(*KEY, "id", F.char_length("text").cast("long").alias("n_chars")))

    # One shuffle of the texts serves the document edited and the one that follows.
    texts = base.repartition(*KEY).groupBy(*KEY).agg(F.first("text").alias("text"))
    asked = order.select(
        F.col("next_k").alias("a_k"), F.col("next_h").alias("a_h"), F.col("k").alias("p_k"),
        F.col("h").alias("p_h"), F.floor(F.col("n_chars") / 4).cast("int").alias("q"))
    heads = texts.join(asked, same_key(texts, asked, KEY, ["a_k", "a_h"])).select(
        "p_k", "p_h", "q", F.substring("text", F.lit(1), F.col("q")).alias("head"))
    edits = texts.join(heads, same_key(texts, heads, KEY, ["p_k", "p_h"])).select(*KEY, F.concat(
        F.substring("text", F.lit(1), F.char_length("text") - F.col("q")), "head").alias("edited"))
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    edited = write_table(
        fingerprints(edits.withColumn("edited_sha256", sha), "edited", words, [*KEY, "edited_sha256"]), "edited")
    release_shuffles(docs.sparkSession)
    # Row by row, because a repeated row would cancel itself out in an exclusive or; no text is moved.
    rows = base.withColumn("row", F.monotonically_increasing_id())
    own = write_table(
        fingerprints(rows, "text", words, [*KEY, "row"]).drop("row").dropDuplicates(KEY), "prints")
    release_shuffles(docs.sparkSession)

    follower = own.select(F.col("k").alias("f_k"), F.col("h").alias("f_h"), F.col("prints").alias("next_prints"))
    result = order.join(own, KEY)
    other = edited.select(F.col("k").alias("e_k"), F.col("h").alias("e_h"), "edited_sha256",
                          F.col("prints").alias("edited_prints"))
    result = result.join(other, same_key(result, other, KEY, ["e_k", "e_h"]))
    result = result.join(follower, same_key(result, follower, ["next_k", "next_h"], ["f_k", "f_h"]))
    return result.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select(
        F.col("id").alias(key), "n_chars", "edited_sha256", as_string(F.col("prints")).alias("fingerprint"),
        as_string(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )
