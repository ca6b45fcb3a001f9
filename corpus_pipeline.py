"""A corpus pipeline: toxicity, near duplicates, repeated passages, mixing, BPE codes.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns
as Parquet to the shared folder and reads it again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoaffinity.llm import bpe_words, jaccard_join, mixing, queries, suffix_dedup, toxicity
from geoaffinity.llm.frames import small_batches, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier predicts to be toxic.

    A document's verdict is its own text's, so rows that share a doc_id are judged each.
    """
    small_batches(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least doc_id.

    Rows without doc_id stay if no other row has their words.
    """
    small_batches(spark)
    return jaccard_join.one_of_each(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more only where they occur first."""
    small_batches(spark)
    return suffix_dedup.without_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids and decoded text, one row for each document of the mix."""
    small_batches(spark)
    return bpe_words.encode_and_decode(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("jaccard_join", jaccard_stage),
    ("suffix_dedup", suffix_stage),
    ("mixing", mixing_stage),
    ("bpe_codes", bpe_stage),
]

#: SQL has no classifier and no BPE; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
