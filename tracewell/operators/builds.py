"""Queries over build databases: tu is (src, dir, object, args, defines, include_paths, target_flags, unhandled, config)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def config_id(defines: Column, include_paths: Column) -> Column:
    """A digest of the ordered definitions and include paths, and of nothing else."""
    return F.sha2(F.to_json(F.struct(defines.alias("d"), include_paths.alias("i"))), 256)


def distinct_configs(tu: DataFrame) -> DataFrame:
    return tu.agg(F.count("*").alias("units"), F.countDistinct("config").alias("configs"))


def units_of(tu: DataFrame, sources: DataFrame) -> DataFrame:
    """Every unit of each source (src); a source may be compiled many times."""
    return sources.join(tu, "src")


def fanout(tu: DataFrame) -> DataFrame:
    return tu.groupBy("src").agg(F.count("*").alias("units"), F.countDistinct("config").alias("configs"))


def flag_sets(tu: DataFrame) -> DataFrame:
    """Distinct target flags: what a compiler is asked once each."""
    return tu.select("target_flags").distinct()


def is_c_unit(path: Column) -> Column:
    return path.rlike(r"\.c$")
