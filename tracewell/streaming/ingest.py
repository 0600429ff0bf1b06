"""Incremental ingest of coverage reports by Structured Streaming.

A demonstration: coverage arrives as files, each is ingested once, and the index is what a batch over all files gives. Sets
and saturating sums merge in any order, and keys are text, so the order of arrival can't show. No watermark: a report that
comes late still counts, and one that never comes leaves its lines unknown, not zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.coverage import coverage_sets

RECORD = "file string, line int, variant string, test int, count decimal(20,0)"


def ingest_records(spark: SparkSession, source: str, out: str, checkpoint: str) -> None:
    """Appends the records of new JSON-lines files under source to the fact table out, exactly once each, then stops."""

    def batch(df: DataFrame, number: int) -> None:
        # A batch that is run again after a failure overwrites its own folder only.
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(RECORD).json(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def index(spark: SparkSession, out: str) -> DataFrame:
    """The coverage index over everything ingested so far."""
    return coverage_sets(spark.read.schema(f"{RECORD}, batch int").parquet(out).drop("batch"))


def first_runs(spark: SparkSession, source: str, out: str, checkpoint: str) -> None:
    """Stateful: (file, line, test) at their first execution only, as they arrive."""
    stream = spark.readStream.schema(RECORD).json(source).where(F.col("count") > 0)
    first = stream.select("file", "line", "test").dropDuplicates(["file", "line", "test"])
    first.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
