"""Coverage reports in the JSON that `gcov --json-format` writes, gzipped or not.

A report that can't be read is an error, never an empty answer: a missing file, bad gzip, text that is no JSON, a report
without files, or a line without its number or count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """format_version string, gcc_version string, current_working_directory string, data_file string,
files array<struct<file: string, functions: array<struct<name: string, demangled_name: string, start_line: int, start_column: int, end_line: int, end_column: int, blocks: int, blocks_executed: int, execution_count: decimal(20,0)>>,
lines: array<struct<line_number: int, function_name: string, count: decimal(20,0), unexecuted_block: boolean, branches: array<struct<count: decimal(20,0), throw: boolean, fallthrough: boolean>>>>>>, _broken string"""


class SourceError(ValueError):
    pass


def report_name(object_stem: str) -> str:
    """What the report of an object is called; of the object's stem, not of its source."""
    return f"{object_stem}.gcov.json.gz"


def read_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """artifact and the parsed report, one row a file."""
    texts = spark.read.option("wholetext", True).text(paths).select(F.input_file_name().alias("artifact"), "value")
    parsed = texts.select("artifact", F.from_json("value", SCHEMA, {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return parsed.select("artifact", "r.*")


def fault() -> F.Column:
    """What is wrong with a report, null if nothing is."""
    bad_line = F.exists("files", lambda f: F.exists(f["lines"], lambda x: x["line_number"].isNull() | x["count"].isNull()))
    return F.when(F.col("_broken").isNotNull(), "not JSON").when(F.col("files").isNull(), "no files").when(bad_line, "a line without number or count")


def refused(reports: DataFrame) -> DataFrame:
    return reports.select("artifact", fault().alias("why")).where("why is not null")


def checked(reports: DataFrame) -> DataFrame:
    """The reports, failing on the first that is at fault when they are read."""
    bad = fault()
    return reports.withColumn("files", F.when(bad.isNotNull(), F.raise_error(F.concat(F.col("artifact"), F.lit(": "), bad))).otherwise(F.col("files")))


def line_records(reports: DataFrame, tests: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """file, line, variant, test, count of reports; tests is (artifact, test, variant), artifacts being told by the end of their path.

    Without tests nothing is attributed. Not strict, reports at fault are left out whole, so that they leave no trace of their
    tests either; refused() names them.
    """
    sound = checked(reports) if strict else reports.where(fault().isNull())
    lines = sound.select("artifact", F.explode("files").alias("f")).select("artifact", F.col("f.file").alias("file"), F.explode("f.lines").alias("l"))
    flat = lines.select("artifact", "file", F.col("l.line_number").alias("line"), F.col("l.count").alias("count"))
    if tests is None:
        return flat.select("file", "line", F.lit("").alias("variant"), F.lit(None).cast("int").alias("test"), "count")
    named = tests.select(F.col("artifact").alias("_a"), "test", F.coalesce("variant", F.lit("")).alias("variant")) if "variant" in tests.columns else tests.select(F.col("artifact").alias("_a"), "test", F.lit("").alias("variant"))
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    return flat.join(named, last(F.col("artifact")) == last(F.col("_a"))).select("file", "line", "variant", "test", "count")


def read_lines(spark: SparkSession, paths: str | list[str], tests: DataFrame | None = None) -> DataFrame:
    reports = read_reports(spark, paths)
    if reports.isEmpty():
        raise SourceError(f"no report at {paths}")
    return line_records(reports, tests)


def ingests(reports: DataFrame) -> DataFrame:
    return reports.where(fault().isNull()).select("artifact", "gcc_version", "format_version", F.lit("Lines").alias("detail"), F.array().cast("array<string>").alias("unsolved"))
