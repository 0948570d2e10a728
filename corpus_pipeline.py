"""Documents to token files: filter by quality, drop near-duplicates, decontaminate, mix, tokenise.

Each stage takes what its predecessor kept, as a table reread from the shared folder, and all but the last
return the columns of ``documents``. A document that the mix takes twice is two rows from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitempo.llm import decontam, minhash, mixing, quality, token_files
from bitempo.llm.queries import tokenizer_definition
from bitempo.llm.text import small_batches, write_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def write_token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_files.token_file(docs, tokenizer_definition())[1]


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_file", write_token_file),
]

# Learned weights, seeded choices and a tokenizer: not sayable in SQL; tested stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
