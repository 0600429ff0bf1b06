"""Interval joins and as-of lookups by buckets, so that they stay equi-joins at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def containing(points: DataFrame, intervals: DataFrame, by: list[str], at: str, lo: str, hi: str, width: float) -> DataFrame:
    """points joined with the intervals lo <= at < hi of the same by.

    Intervals are cut at multiples of width; one that spans very many buckets isn't cut but kept in a coarser level, so
    an interval makes at most 16 rows: levels are widths of width * 16**k, and a point looks into each level used.
    """
    span = F.greatest((F.col(hi) - F.col(lo)) / width, F.lit(1.0))
    level = F.ceil(F.log(16.0, span) - 1e-12).cast("int")
    cut = intervals.where(F.col(lo) < F.col(hi)).withColumn("_level", F.greatest(level - 1, F.lit(0))).withColumn("_width", F.pow(F.lit(16.0), "_level") * width)
    cut = cut.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(lo) / F.col("_width")).cast("long"), F.floor(F.col(hi) / F.col("_width")).cast("long"))))
    levels = [r[0] for r in cut.select("_level").distinct().collect()]  # a few small numbers
    if not levels:
        levels = [0]
    spots = points.withColumn("_level", F.explode(F.array(*map(F.lit, sorted(levels))))).withColumn("_bucket", F.floor(F.col(at) / (F.pow(F.lit(16.0), "_level") * width)).cast("long"))
    return spots.join(cut.drop("_width"), [*by, "_level", "_bucket"]).where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_level", "_bucket")


def overlapping(a: DataFrame, b: DataFrame, by: list[str], a_lo: str, a_hi: str, b_lo: str, b_hi: str, width: int) -> DataFrame:
    """Pairs of half-open intervals of the same by that overlap, each once."""
    cut = lambda d, lo, hi: d.where(F.col(lo) < F.col(hi)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    both = cut(a, a_lo, a_hi).join(cut(b, b_lo, b_hi), [*by, "_bucket"]).where((F.col(a_lo) < F.col(b_hi)) & (F.col(b_lo) < F.col(a_hi)))
    # A pair meets in several buckets; the one that holds the start of the overlap reports it.
    return both.where(F.col("_bucket") == F.floor(F.greatest(a_lo, b_lo) / width)).drop("_bucket")


def as_of(points: DataFrame, starts: DataFrame, by: list[str], at: str, start: str) -> DataFrame:
    """points with the last row of starts whose start is at or before it; unmatched points have nulls.

    Both sides are laid on one axis and the last start is carried forward, one sort by (by, position).
    """
    named = [c for c in starts.columns if c not in by]
    p = points.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*points.columns).alias("_p"), F.lit(None).cast(starts.select(F.struct(*named)).schema[0].dataType).alias("_s"))
    s = starts.select(*by, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.struct(*named).alias("_s"))
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(s).withColumn("_last", F.last("_s", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_p.*", *(F.col(f"_last.{c}").alias(c) for c in named))


def located(points: DataFrame, lines: DataFrame, width: int = 4096) -> DataFrame:
    """points (tu, pos) with file, line and column (from 1) of the line that holds the position; nulls where none does.

    lines is (tu, file, line, lo, hi): the positions of each line of each file of a unit, half-open.
    """
    spots = points.select("tu", "pos").distinct()
    found = containing(spots, lines, ["tu"], "pos", "lo", "hi", width).select("tu", "pos", "file", "line", (F.col("pos") - F.col("lo") + 1).alias("column"))
    return points.join(found, ["tu", "pos"], "left")
