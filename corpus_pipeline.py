"""A corpus pipeline over documents: STAGES, each on what its predecessor kept; run() applies them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, exact_dedup, mixing, ngram_join, quality, sentencepieces


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    return quality.good_documents(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the longest original with the smallest doc_id stays."""
    return exact_dedup.without_duplicates(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, the smallest doc_id stays."""
    return ngram_join.without_linked(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and round_trip of each row that is left."""
    import public_tokenizers

    return sentencepieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", filter_quality), ("exact dedup", dedup_exact), ("near dedup", dedup_near), ("mixing", mix), ("sentencepieces", encode)]

#: Mixing and the quality model are iterative, so SQL can't express run(); tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
