"""Compilation databases: one row a translation unit, nothing dropped silently."""

from __future__ import annotations

import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.builds import config_id

ENTRY = "file string, directory string, output string, command string, arguments array<string>"
UNITS = "src string, dir string, object string, args array<string>, defines array<string>, include_paths array<string>, target_flags array<string>, unhandled array<string>"
#: Flags that choose the target, by beginning.
TARGET = ("-m", "--target", "-target", "-std", "-f", "-O", "-g", "-pthread")
#: Flags without a meaning here; those of the second kind take the next argument.
SKIP, SKIP_NEXT = ("-c", "-S", "-E", "-W", "-w", "-M", "-pipe"), ("-o", "-MF", "-MT", "-MQ", "-x")


class DatabaseError(ValueError):
    pass


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a database; text that isn't an array of objects is an error, never no entries."""
    text = spark.read.option("wholetext", True).text(path)
    parsed = text.select(F.from_json("value", f"array<struct<{', '.join(': '.join(c.split()) for c in ENTRY.split(', '))}>>").alias("e"), F.trim("value").startswith("[").alias("is_array"))
    bad = F.col("e").isNull() | ~F.col("is_array")
    return parsed.select(F.explode(F.when(bad, F.raise_error(F.lit(f"{path}: not an array of entries"))).otherwise(F.col("e"))).alias("e")).select("e.*")


def split_flags(args: list[str]) -> tuple[list[str], list[str], list[str], list[str]]:
    """(defines, include paths, target flags, unhandled) of a compiler's arguments, each in order."""
    defines, paths, target, other = [], [], [], []
    rest = iter(args[1:])
    for a in rest:
        if a in ("-D", "-U", "-I", "-isystem", "-iquote"):
            value = next(rest, "")
            (defines if a in ("-D", "-U") else paths).append(_define(a, value) if a in ("-D", "-U") else value)
        elif a.startswith(("-D", "-U")):
            defines.append(_define(a[:2], a[2:]))
        elif a.startswith("-I"):
            paths.append(a[2:])
        elif a in SKIP_NEXT:
            next(rest, None)
        elif a.startswith("-include") or a == "-imacros":
            other.append(f"{a} {next(rest, '')}".strip())
        elif a.startswith(TARGET):
            target.append(a)
        elif a.startswith("-") and not a.startswith(SKIP):
            other.append(a)
    return defines, paths, target, other


def _define(flag: str, text: str) -> str:
    if flag == "-U":
        return f"-U{text}"
    name, eq, value = text.partition("=")
    return f"{name}={value if eq else '1'}"


def units(entries: DataFrame) -> DataFrame:
    """Translation units with their config digest; entries without arguments aren't compilations, see phony()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for _, r in b.iterrows():
                args = list(r["arguments"]) if r["arguments"] is not None and len(r["arguments"]) else shlex.split(r["command"] or "")
                if args:
                    rows.append((r["file"], r["directory"], r["output"], args, *split_flags(args)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in UNITS.split(", ")])

    return entries.mapInPandas(run, UNITS).withColumn("config", config_id(F.col("defines"), F.col("include_paths")))


def phony(entries: DataFrame) -> DataFrame:
    """How many entries have nothing to run."""
    return entries.agg(F.count_if((F.size(F.coalesce("arguments", F.array().cast("array<string>"))) == 0) & (F.trim(F.coalesce("command", F.lit(""))) == "")).alias("phony"))
