"""A compiler's predefined macros, as its dump of definitions lists them, one `#define` a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFINE = r"^\s*#\s*define\s+([A-Za-z_$][\w$]*)(\(([^)]*)\))?(?:\s+(.*?))?\s*$"


def scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, name, params (null for object-like macros), body of every definition; other lines are left out."""
    line = F.col("value")
    part = lambda k: F.regexp_extract(line, DEFINE, k)
    names = F.filter(F.transform(F.split(part(3), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value").where(line.rlike(DEFINE))
    return rows.select("path", part(1).alias("name"), F.when(part(2) != "", names).alias("params"), part(4).alias("body"))


def differing(macros: DataFrame, a: str, b: str) -> DataFrame:
    """name, ours, theirs: macros that two dumps (paths) define differently or only one has (null)."""
    shape = F.struct("params", "body")
    one = lambda path, name: macros.where(F.col("path") == path).select("name", shape.alias(name))
    both = one(a, "ours").join(one(b, "theirs"), "name", "full_outer")
    return both.where(~F.col("ours").eqNullSafe(F.col("theirs")))
