"""Sets of constraints as tables: what bears on a question, and lookups among sets that were answered before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.fixpoint import connected


def split(mentions: DataFrame, asked: DataFrame) -> DataFrame:
    """constraint, component, relevant for mentions (constraint, var) and the variables asked (var).

    Constraints that share a variable, directly or through others, are one component, named by its smallest variable; it
    is relevant if a variable asked for is in it. A constraint without variables (null) has no component and isn't relevant.
    """
    known = mentions.where("var is not null")
    first = known.groupBy("constraint").agg(F.min("var").alias("a"))
    names = connected(known.join(first, "constraint").select("a", F.col("var").alias("b")).distinct()).withColumnsRenamed({"node": "a"})
    wanted = names.join(asked.select(F.col("var").alias("a")).distinct(), "a", "left_semi").select("component").distinct().withColumn("relevant", F.lit(True))
    each = mentions.groupBy("constraint").agg(F.min("var").alias("a")).join(names, "a", "left").join(wanted, "component", "left")
    return each.select("constraint", "component", F.coalesce("relevant", F.lit(False)).alias("relevant"))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner, outer: every pair in which all items of inner (set, item) are among those of outer (set, item).

    A set is looked up by the item of it that the fewest outer sets hold, and a hit is confirmed on the whole sets. Cached
    sets as inner find an unsatisfiable core of a question; cached sets as outer find a model that covers it.
    Empty sets have no rows, so they are in no pair.
    """
    big = outer.select(F.col("set").alias("outer"), "item").where("item is not null").distinct()
    small = inner.select(F.col("set").alias("inner"), "item").where("item is not null").distinct()
    held = big.groupBy("item").agg(F.count("*").alias("n"))
    rare = small.join(held, "item", "left").groupBy("inner").agg(F.min_by("item", F.struct(F.coalesce("n", F.lit(0)), "item")).alias("item"))
    sets = lambda df, name: df.groupBy(name).agg(F.collect_set("item").alias(f"{name}_items"))
    hits = rare.join(big, "item").select("inner", "outer").join(sets(small, "inner"), "inner").join(sets(big, "outer"), "outer")
    return hits.where(F.size(F.array_except("inner_items", "outer_items")) == 0).select("inner", "outer")
