"""Queries of this subpackage for the driver: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontaminate, language_id, mixing, near_dedup, quality, quality_rules, suffix_dedup, token_counts, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_quality": quality.op2_quality,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_mixing": mixing.op4_mixing,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_language_id": language_id.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {}
