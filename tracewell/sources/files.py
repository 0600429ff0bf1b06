"""Small text sources and sinks: manifests, corpora, sidecars, source trees, stored facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class EmptySource(ValueError):
    pass


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, path, test of NAME<TAB>PATH lines; `#` starts a comment; a repeated name keeps its number; none is an error."""
    rows = spark.read.text(path).where("trim(value) <> '' and not value like '#%'").select(F.split("value", "\t", 2).alias("p"), F.monotonically_increasing_id().alias("ord"))
    rows = rows.select(F.trim(F.col("p")[0]).alias("name"), F.when(F.size("p") < 2, F.raise_error(F.concat(F.lit("no path: "), F.col("p")[0]))).otherwise(F.trim(F.get("p", F.lit(1)))).alias("path"), "ord")
    if rows.isEmpty():
        raise EmptySource(f"{path} names nothing")
    first = rows.groupBy("name").agg(F.min("ord").alias("first")).orderBy("first").collect()  # one row a test of the suite
    ids = spark.createDataFrame([(r["name"], k) for k, r in enumerate(first)], "name string, test int")
    return rows.join(F.broadcast(ids), "name").select("name", "path", "test")


def read_replay_corpus(spark: SparkSession, path: str) -> DataFrame:
    """commit, test, evidence, note of a tab-separated corpus."""
    return spark.read.csv(path, sep="\t", comment="#", schema="commit string, test string, evidence string, note string").where("commit <> 'commit'")


def source_tree(spark: SparkSession, root: str, pattern: str = "*.c") -> DataFrame:
    """path and text of the files under a root, sorted by path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.col("content").cast("string").alias("text")).orderBy("path")


def source_hashes(files: DataFrame) -> DataFrame:
    """file, hash of (file, text)."""
    return files.select("file", F.sha2("text", 256).alias("hash"))


def write_sidecars(rows: DataFrame, path: str) -> None:
    """Appends one JSON line a row; readers see whole files only."""
    rows.write.mode("append").json(path)


def summarize_sidecars(spark: SparkSession, path: str, schema: str, by: str) -> DataFrame:
    return spark.read.json(path, schema=schema).groupBy(by).agg(F.count("*").alias("n"))


def write_facts(df: DataFrame, path: str, *by: str) -> None:
    """Stores a fact table as Parquet, split and sorted by the columns that queries filter on, so that scans prune."""
    out = df.repartition(*by).sortWithinPartitions(*by) if by else df
    out.write.mode("overwrite").parquet(path)
