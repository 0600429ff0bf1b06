"""The training-data pipeline: documents through the stages below, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontaminate, language_id, mixing, near_dedup, suffix_dedup
from tracewell.llm._spark import stored, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters or with an unclear language go."""
    return language_id.keep_identified(docs)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.keep_one(docs)


def repeats_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that repeat; a document of which nothing is left keeps its row, with an empty text."""
    return suffix_dedup.remove_repeats(docs, size="n_chars")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the benchmark."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that half of the tokens stay, at tempered shares of sources, languages and topics."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", identified),
    ("near_dedup", near_deduplicated),
    ("suffix_dedup", repeats_removed),
    ("decontaminate", decontaminated),
    ("mixing", mixed),
]

#: Fitted models and fingerprints are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
