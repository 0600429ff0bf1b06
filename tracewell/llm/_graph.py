"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._spark import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of edges (a, b).

    Each round links every node to the smallest node next to it, first its larger neighbours, then its
    smaller ones, until nothing changes: then all edges point to the component's smallest node. Rounds
    grow as the logarithm of the longest path, a hot node's minimum is aggregated before its shuffle, and each
    round is written to the shared folder. Null ends and self-loops are ignored.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    told = _told(now)
    while told[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = stored(small)
        dropped(now)
        before, told, now = told, _told(after), after
        if told == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _told(edges: DataFrame) -> tuple:
    # As decimals, which no number of edges overflows.
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(r)
