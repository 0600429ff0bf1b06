"""Shared folders, bounded samples and checkpoints for the operators of this subpackage."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is set and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tracewell-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def files_of_advisory_size(spark: SparkSession) -> Iterator[None]:
    """Within it, small shuffles are merged to partitions of the advisory size, not to as many as there are cores: loops write few files."""
    name = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage, survives lost executors; removed when the driver ends."""
    spark = df.sparkSession
    path, schema = f"{shared_dir(spark)}/tracewell/{uuid.uuid4().hex}", df.schema
    with files_of_advisory_size(spark):
        df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    del df
    gc.collect()
    spark._jvm.System.gc()  # so that Spark removes the shuffle files of steps that nothing refers to any more
    return spark.read.schema(schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Removes the files of frames made by stored(), once nothing reads them."""
    for df in frames:
        spark = df.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keyed(df: DataFrame, key: str, *cols) -> DataFrame:
    """The key and the named columns only, so that extra columns with clashing names can't matter."""
    return df.select(F.col(key), *cols)


def unit_hash(col) -> F.Column:
    """A number in [0, 1) that depends on the value only."""
    return F.pmod(F.xxhash64(col, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def bounded(df: DataFrame, key: str, limit: int) -> DataFrame:
    """About limit rows of df, chosen by a hash of the key; all of them if there are no more than that."""
    n = df.count()
    return df if n <= limit else df.where(unit_hash(F.col(key)) < F.lit(limit / n))
