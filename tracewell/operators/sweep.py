"""Agreement of two tools over many files, and how far each file got."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("read", "preprocessed", "parsed", "lowered")


def bucket(theirs: Column, ours: Column) -> Column:
    """What a pair of outcomes means; outcomes are Clean, Advised, Warned, Diagnosed, NotRun."""
    refused, warned = ours.isin("Advised", "Diagnosed", "Warned"), ours.isin("Diagnosed", "Warned")
    return (
        F.when((ours == "NotRun") | ~theirs.isin("Clean", "Warned", "Diagnosed"), "ToolGap")
        .when(theirs == "Clean", F.when(refused, "Finding").otherwise("Agree"))
        .when(ours == "Clean", "Miss")
        .when(theirs == "Diagnosed", "BothRefused")
        .when(warned, "SeverityMismatch")
        .otherwise("Agree")
    )


def buckets(verdicts: DataFrame) -> DataFrame:
    """bucket, n over verdicts (path, theirs, ours)."""
    return verdicts.groupBy(bucket(F.col("theirs"), F.col("ours")).alias("bucket")).agg(F.count("*").alias("n"))


def report(verdicts: DataFrame, top: int = 25) -> DataFrame:
    """bucket, key, n, example, more: message groups of each bucket, most frequent first, and how many groups are beyond the top."""
    keyed = verdicts.select(bucket(F.col("theirs"), F.col("ours")).alias("bucket"), F.coalesce(F.substring_index("ours_msg", ":", 1), F.concat_ws("/", "theirs", "ours")).alias("key"), "path")
    g = keyed.groupBy("bucket", "key").agg(F.count("*").alias("n"), F.min("path").alias("example"))
    w = Window.partitionBy("bucket")
    ranked = g.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "key"))).withColumn("groups", F.count("*").over(w))
    return ranked.where(F.col("r") <= top).select("bucket", F.col("r").alias("rank"), "key", "n", "example", F.greatest(F.col("groups") - top, F.lit(0)).alias("more"))


def parser_coverage(files: DataFrame) -> DataFrame:
    """files, preprocessed, parsed and percent (of the preprocessed, one decimal; 0 of none) of files (path, stage 0..3)."""
    c = files.agg(F.count("*").alias("files"), F.count_if(F.col("stage") >= 1).alias("preprocessed"), F.count_if(F.col("stage") >= 2).alias("parsed"))
    return c.select("files", "preprocessed", "parsed", F.when(F.col("preprocessed") > 0, F.round(100.0 * F.col("parsed") / F.col("preprocessed"), 1)).otherwise(0.0).alias("percent"))


def contract_coverage(docs: DataFrame, tests: DataFrame, pattern: str = r"contract\s+([0-9]+)") -> DataFrame:
    """doc, contracts, cited: numbered contracts of documents (doc, text) and how many of them tests (doc, text) cite."""
    numbers = lambda d: d.select("doc", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), 1)).alias("n")).distinct()
    cited = numbers(tests).withColumn("cited", F.lit(1))
    return numbers(docs).join(cited, ["doc", "n"], "left").groupBy("doc").agg(F.count("*").alias("contracts"), F.count("cited").alias("cited"))
