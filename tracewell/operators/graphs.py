"""Checks on directed graphs: cycles, layering, unreachable blocks, dominators. All are frontier loops over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.fixpoint import written


def _spread(seeds: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """key and node of all that seeds (key, node) reach along edges (key, src, dst), seeds included."""
    level = written(seeds.select(*key, "node").distinct())
    placed, steps = level, written(edges.select(*key, "src", "dst").distinct())
    while True:
        ahead = level.withColumnRenamed("node", "src").join(steps, [*key, "src"]).select(*key, F.col("dst").alias("node")).distinct()
        level = written(ahead.join(placed, [*key, "node"], "left_anti"))
        if level.isEmpty():
            return placed
        placed = written(placed.unionByName(level))


def cycles(edges: DataFrame) -> DataFrame:
    """node, component: every node on a cycle of edges (src, dst), and the largest node of its strong component.

    The largest node that reaches a node colours it; what reaches back to that largest node within its colour is one strong
    component. Those are taken out, and the rest is coloured again.
    """
    left = written(edges.select("src", "dst").distinct())
    loops = left.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    found = written(loops)
    left = left.where("src <> dst")
    while True:
        # Only nodes with edges in and out can be on a cycle.
        while True:
            n = left.count()
            left = written(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if left.count() == n:
                break
        if not n:
            return found.groupBy("node").agg(F.max("component").alias("component"))
        colour = written(left.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            into = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("c"))
            now = written(colour.join(into, "node").select("node", F.greatest("colour", "c").alias("colour"), (F.col("c") > F.col("colour")).alias("moved")))
            if now.where("moved").isEmpty():
                break
            colour = now.select("node", "colour")
        of = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"c_{end}"))
        inside = left.join(of("src"), "src").join(of("dst"), "dst").where("c_src = c_dst")
        back = _spread(colour.where("node = colour").select("colour", "node"), inside.select(F.col("c_src").alias("colour"), F.col("dst").alias("src"), F.col("src").alias("dst")), ["colour"])
        alone = back.groupBy("colour").agg(F.count("*").alias("n")).where("n = 1").select("colour")
        whole = back.join(alone, "colour", "left_anti").select("node", F.col("colour").alias("component"))
        found = written(found.unionByName(whole))
        gone = back.select("node")
        left = written(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))


def layering(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """src, dst: distinct dependencies of a lower layer on a higher one; layers is (node, layer), and unlisted nodes may use all."""
    of = lambda end: layers.select(F.col("node").alias(end), F.col("layer").alias(f"l_{end}"))
    return edges.select("src", "dst").distinct().join(of("src"), "src").join(of("dst"), "dst").where("l_src < l_dst").select("src", "dst")


def unreachable(blocks: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """func, node of blocks (func, node) that no path of edges (func, src, dst) leads to from the function's entry (func, node)."""
    return blocks.select("func", "node").join(_spread(entries, edges, ["func"]), ["func", "node"], "left_anti")


def dominators(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """func, node, dominator, immediate: the proper dominators of every reachable block.

    A block dominates those that can't be reached around it. All blocks of a function are left out in turn, in one
    loop: its table has as many rows as the function has pairs of blocks.
    """
    reach = written(_spread(entries, edges, ["func"]))
    entry = entries.select("func", F.col("node").alias("entry"))
    without = reach.withColumnRenamed("node", "out").join(entry, "func").where("out <> entry").select("func", "out", F.col("entry").alias("node"))
    around = edges.join(reach.withColumnRenamed("node", "out"), "func").where("src <> out and dst <> out").select("func", "out", "src", "dst")
    passed = _spread(without, around, ["func", "out"])
    pairs = reach.join(reach.withColumnRenamed("node", "out"), "func").where("node <> out")
    found = written(pairs.join(passed, ["func", "out", "node"], "left_anti").select("func", "node", F.col("out").alias("dominator")))
    depth = found.groupBy("func", F.col("node").alias("dominator")).agg(F.count("*").alias("depth"))
    last = found.join(depth, ["func", "dominator"], "left").groupBy("func", "node").agg(F.max_by("dominator", F.coalesce("depth", F.lit(0))).alias("last"))
    return found.join(last, ["func", "node"]).select("func", "node", "dominator", (F.col("dominator") == F.col("last")).alias("immediate"))
