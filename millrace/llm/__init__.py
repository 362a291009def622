"""Operators of a training-data pipeline: each in its own module, with its query and SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from millrace.llm import exact_dedup, language_id, line_dedup, mixing, ngram_join, pii, quality, sentencepieces, token_counts, toxicity

    return {
        "op1_language_id": language_id.query,
        "op2_pii": pii.query,
        "op3_exact_dedup": exact_dedup.query,
        "op4_line_dedup": line_dedup.query,
        "op5_ngram_join": ngram_join.query,
        "op6_mixing": mixing.query,
        "op7_sentencepieces": sentencepieces.query,
        "op8_toxicity": toxicity.query,
        "op9_quality": quality.query,
        "op10_token_counts": token_counts.query,
    }


def oracle_sql() -> dict[str, str]:
    from millrace.llm import exact_dedup, line_dedup

    return {"op3_exact_dedup": exact_dedup.SQL, "op4_line_dedup": line_dedup.SQL}
