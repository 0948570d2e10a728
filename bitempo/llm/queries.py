"""Each operator over its whole table, with production parameters, in the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontam, imatch, langid, lexical, licenses, manifest, minhash, mixing, quality, sigtree, substring, token_files,
    toxicity,
)
from .oracle import ORACLE  # noqa: F401
from .text import documents

TOKENIZER = "byte_bpe_50k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_definition(name: str = TOKENIZER) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return token_files.token_file(docs, tokenizer_definition())[1]


@query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    sized = docs.select(
        "doc_id", F.array(F.col("source")).alias("sources"), mixing.text_size(F.col("text")).alias("size")
    )
    result = mixing.mix(sized)
    rows = result.units.withColumn("source", F.element_at("sources", 1)).withColumn(
        "one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    )
    match = rows["source"].eqNullSafe(result.sources["source"])
    return rows.join(result.sources, match).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), rows["source"], "copies",
    )


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontam.with_verdict(docs, tests, "v")
    return judged.select(
        "doc_id", "v.n_words", "v.n_hit", F.size("v.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("v.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("v.n_hit") > 0).alias("contaminated"),
    )


def bucket(parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = F.coalesce(bucket(4) == 2, F.lit(False))
    model = langid.learn(docs.filter(~held_out))
    judged = docs.select("doc_id", held_out.alias("held_out"), langid.predict(F.col("text"), model, spark).alias("p"))
    return judged.select("doc_id", "held_out", "p.lang_pred", "p.score", F.array_join("p.languages", ",").alias("languages"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.coalesce(bucket(5) == 0, F.lit(False))
    model = toxicity.learn(docs.filter(~held_out), labels.filter(bucket(5) != 0))
    score = toxicity.score(F.col("text"), model, spark)
    return docs.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.resample(docs, quality.learn(docs, labels))


@query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = minhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir, "doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_edits(documents(spark, sf_dir, "doc_id", "text"))


@query
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = substring.remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(documents(spark, sf_dir, "doc_id", "text"))
    return lexical.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = sigtree.jaccard_components(documents(spark, sf_dir, "doc_id", "text"))
    return judged.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "source", "lang", "n_chars", "text")
    stripped = F.when(bucket(2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaves = manifest.dataset_leaves(docs, ["doc_id", "source", "lang", "n_chars", "text"], text=stripped)
    return manifest.manifest(leaves)
