"""Frontier loops: graph traversals that end on cyclic graphs.

Each round joins the frontier with the edges, drops what is already placed and writes the new level, so lineage
stays short and a lost executor costs one level. The driver sees counts only.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Levels of a walk to the roots between two tables that are written.
STRIDE = 4


def shared_folder(spark: SparkSession) -> str:
    """Where levels are written: spark.checkpoint.dir, or a temporary folder only where none is set and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tracewell-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared folder; removed when the driver ends."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/levels/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(schema).parquet(path)


def reached(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, distance for all nodes reachable from seeds (node) along edges (src, dst), shortest first."""
    level = written(seeds.select("node").distinct().withColumn("distance", F.lit(0)))
    placed, depth = level, 0
    steps = written(edges.select("src", "dst").distinct())
    while max_depth is None or depth < max_depth:
        depth += 1
        ahead = level.join(steps, level["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct()
        level = written(ahead.join(placed, "node", "left_anti").withColumn("distance", F.lit(depth)))
        if level.isEmpty():
            break
        placed = written(placed.unionByName(level)) if depth % 8 == 0 else placed.unionByName(level)
    return placed


def reached_in_order(seeds: DataFrame, edges: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """The bounded closure in breadth-first order, and the distinct nodes one step beyond the bound.

    seeds is (node, ord), edges (src, dst, ord). A node is placed by its first holder in the order, through that
    holder's first edge. The first table is (node, depth, path): the order is by depth, then path, which lists the
    ordinals of the seed and the edges that led there, so levels need no global ranks. The second is (node).
    """
    level = written(seeds.groupBy("node").agg(F.min("ord").cast("long").alias("o")).select("node", F.lit(0).alias("depth"), F.array("o").alias("path")))
    placed = level
    steps = written(edges.select("src", "dst", F.col("ord").cast("long").alias("e")))
    for depth in range(1, max_depth + 1):
        ahead = level.join(steps, level["node"] == steps["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("e"))).alias("path"))
        level = written(ahead.join(placed, "node", "left_anti").select("node", F.lit(depth).alias("depth"), "path"))
        if level.isEmpty():
            break
        placed = placed.unionByName(level)
    beyond = placed.join(steps, placed["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct().join(placed, "node", "left_anti")
    return placed, beyond


def ancestors(parents: DataFrame) -> DataFrame:
    """node, ancestor, depth for every proper ancestor, by pointer doubling over (node, parent); a cycle ends."""
    step = written(parents.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    every, n, span = step, step.count(), 1
    while True:
        # Paths of up to 2 * span edges: those of up to span, each followed by exactly span or fewer.
        ahead = every.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("beyond"), F.col("depth").alias("more"))
        longer = every.where(F.col("depth") == span).join(ahead, "ancestor").select("node", F.col("beyond").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        every = written(every.unionByName(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        after, span = every.count(), span * 2
        if after == n:
            return every
        n = after


def upward(wanted: DataFrame, parents: DataFrame) -> DataFrame:
    """start, node, depth: each wanted (node) and all its ancestors over (node, parent), STRIDE levels a round; a cycle ends.

    Only what lies above the wanted nodes is touched, whatever the size of the forest.
    """
    placed = level = wanted.select(F.col("node").alias("start"), "node").distinct().withColumn("depth", F.lit(0))
    depth, up = 0, parents.where("parent is not null").select(F.col("node"), F.col("parent").alias("above"))
    while True:
        found = None
        for _ in range(STRIDE):
            depth += 1
            level = level.join(up, "node").select("start", F.col("above").alias("node"), F.lit(depth).alias("depth"))
            found = level if found is None else found.unionByName(level)
        found = written(found.groupBy("start", "node").agg(F.min("depth").alias("depth")).join(placed, ["start", "node"], "left_anti"))
        placed, level = placed.unionByName(found), found.where(F.col("depth") == depth)
        if level.isEmpty():
            return placed


def roots(parents: DataFrame) -> DataFrame:
    """node, root, depth: the outermost ancestor of every node, a root's being itself; nodes on a cycle have none.

    Pointer jumping: each round doubles how far every pointer reaches, so it takes log2(depth) joins.
    """
    now = written(parents.select("node", F.coalesce("parent", "node").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.col("parent").isNull().alias("done")))
    most = 1
    total = now.count()
    while most <= max(2, 2 * total):
        ahead = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("done").alias("done2"))
        now = written(now.join(ahead, "up", "left").select("node", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.when(F.col("done"), 0).otherwise(F.coalesce("d2", F.lit(0)))).alias("depth"), (F.col("done") | F.coalesce("done2", F.lit(True))).alias("done")))
        if now.where("not done").isEmpty():
            break
        most *= 2
    return now.where("done").select("node", F.col("up").alias("root"), "depth")


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of an undirected graph (a, b): the least label spreads and jumps until still."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = written(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(label.withColumnsRenamed({"node": "b", "component": "c"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        lower = label.join(near, "node").select("node", "component", F.least("component", "c").alias("c"))
        up = lower.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        now = written(lower.join(up, "c").select("node", F.least("c", "cc").alias("c"), "component"))
        if now.where("c <> component").isEmpty():
            return now.select("node", "component")
        label = now.select("node", F.col("c").alias("component"))
