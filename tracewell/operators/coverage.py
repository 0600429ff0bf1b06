"""Line and arc coverage: ingest, merge rules and the read surface.

The index is one table, `sets`: a row for each (file, line, variant) that some build recorded, with the saturating sum
of its counts, whether it was attributed to tests at all, and the distinct tests that executed it. Aggregation to it
is partial before its only shuffle; every query below is a filter or a further aggregation of it, and
keeps three answers apart: null (nothing recorded), [] (recorded, not executed) and a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.facts import COUNT, largest, recorded_set, saturating_sum
from tracewell.operators.fixpoint import roots

OUTCOMES = ("Passed", "Failed", "Crashed", "TimedOut", "NotRun")
#: A process that ends in one of these has written its counters.
FLUSHED = ("Passed", "Failed")
ABSENT = "<absent>"
FAKE_ARC = 2


def coverage_sets(records: DataFrame) -> DataFrame:
    """The index of records (file, line, variant, test, count); test is null where the scan had no test."""
    ran = F.when(F.col("count") > 0, F.col("test"))
    return records.groupBy("file", "line", "variant").agg(saturating_sum("count").alias("count"), F.max(F.col("test").isNotNull()).alias("attributed"), F.collect_set(ran).alias("tests"))


def line_count(sets: DataFrame) -> DataFrame:
    """file, line, count: sums over builds and objects; a line without a row was never recorded."""
    return sets.groupBy("file", "line").agg(saturating_sum("count").alias("count"))


def lines_of(sets: DataFrame, file) -> DataFrame:
    return sets.where(F.col("file") == file).select("line").distinct().orderBy("line")


def uncovered_lines(sets: DataFrame) -> DataFrame:
    """file, line of what is recorded and zero."""
    return line_count(sets).where("count = 0").select("file", "line")


def tests_for_lines(sets: DataFrame) -> DataFrame:
    """file, line, tests over all builds; null where no build attributed the line."""
    each = sets.select("file", "line", "attributed", F.explode_outer("tests").alias("test"))
    return each.groupBy("file", "line").agg(recorded_set(F.col("attributed"), F.col("test")).alias("tests"))


def tests_for_lines_in(sets: DataFrame, variant: str) -> DataFrame:
    """The same for one build; a line that only other builds recorded has no row."""
    return sets.where(F.col("variant") == variant).select("file", "line", F.when(F.col("attributed"), F.sort_array("tests")).alias("tests"))


def tests_for_asked(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """ask, tests: the union over the lines (ask, file, line) that are asked for; null only if none is recorded."""
    each = sets.select("file", "line", "attributed", F.explode_outer("tests").alias("test"))
    found = asked.join(each, ["file", "line"], "left")
    return found.groupBy("ask").agg(recorded_set(F.col("attributed"), F.col("test")).alias("tests"))


def tests_for_ranges(sets: DataFrame, ranges: DataFrame, width: int = 64) -> DataFrame:
    """ask, tests for line ranges (ask, file, lo, hi), both ends included.

    The ranges are cut at multiples of width, so the join is on (file, bucket) with a residual filter, whatever the sizes.
    """
    cut = ranges.select("*", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.greatest("lo", "hi") / width))).alias("bucket"))
    each = sets.select("file", "line", F.floor(F.col("line") / width).alias("bucket"), "attributed", F.explode_outer("tests").alias("test"))
    hit = cut.join(each, ["file", "bucket"]).where("line between lo and hi").select("ask", "attributed", "test")
    return ranges.select("ask").distinct().join(hit, "ask", "left").groupBy("ask").agg(recorded_set(F.col("attributed"), F.col("test")).alias("tests"))


def tests_for_blocks(sets: DataFrame, blocks: DataFrame) -> DataFrame:
    """block, tests over the lines of (block, lines array<struct<file, line>>); a block without lines has null."""
    asked = blocks.select(F.col("block").alias("ask"), F.explode_outer("lines").alias("l")).select("ask", F.col("l.file").alias("file"), F.col("l.line").alias("line"))
    return tests_for_asked(sets, asked).withColumnRenamed("ask", "block")


def files(records: DataFrame) -> DataFrame:
    """Files in the order of their first record (ord)."""
    return records.groupBy("file").agg(F.min("ord").alias("ord")).orderBy("ord")


def coverage_complete() -> Column:
    """Of a test (ingested, outcome): its counters are all there. No outcome: no."""
    return F.coalesce(F.col("outcome").isin(*FLUSHED) & F.col("ingested"), F.lit(False))


def always_run(tests: DataFrame) -> DataFrame:
    """Tests with a recorded outcome that aren't complete."""
    return tests.where(F.col("outcome").isNotNull() & ~coverage_complete()).select("test").orderBy("test")


def validity(recorded: DataFrame, current: DataFrame, tests: DataFrame) -> DataFrame:
    """One row: state Stale (files: which changed), Partial (tests: which are incomplete) or Fresh, in that order.

    recorded and current are (file, hash); a file that is gone now counts as changed.
    """
    now = current.select("file", F.col("hash").alias("now"))
    changed = recorded.join(now, "file", "left").where(F.coalesce("now", F.lit(ABSENT)) != F.col("hash")).agg(F.sort_array(F.collect_set("file")).alias("files"))
    partial = always_run(tests).agg(F.sort_array(F.collect_set("test")).alias("tests"))
    both = changed.crossJoin(partial)  # one row each
    return both.select(F.when(F.size("files") > 0, "Stale").when(F.size("tests") > 0, "Partial").otherwise("Fresh").alias("state"), "files", "tests")


def detail(ingests: DataFrame) -> DataFrame:
    """LinesAndArcs only if every ingest offered arcs."""
    return ingests.agg(F.when(F.min((F.col("detail") == "LinesAndArcs").cast("int")) == 1, "LinesAndArcs").otherwise("Lines").alias("detail"))


def merged_in_object(parts: DataFrame) -> DataFrame:
    """object, file, line, count from what each function offers (object, file, line, kind, count).

    kind graphed: counted on the function's own graph; accumulated: summed over blocks; private: resolved within a group of
    functions that share a start. If any function graphed a line, accumulations of it don't count; private ones are added.
    """
    of = lambda kind: saturating_sum(F.when(F.col("kind") == kind, F.col("count")))
    g = parts.groupBy("object", "file", "line").agg(of("graphed").alias("g"), of("accumulated").alias("a"), of("private").alias("p"))
    zero = F.lit(0).cast(COUNT)
    total = F.coalesce("g", "a", zero).cast("decimal(38,0)") + F.coalesce("p", zero)
    return g.select("object", "file", "line", F.least(total, largest()).cast(COUNT).alias("count"))


def merged_over_objects(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file", "line").agg(saturating_sum("count").alias("count"))


def real_arcs(arcs: DataFrame) -> DataFrame:
    """Arcs that aren't fake, in the order of their declaration."""
    return arcs.where(F.col("flags").bitwiseAND(FAKE_ARC) == 0).orderBy("func", "arc_ix")


def merged_arcs(arcs: DataFrame) -> DataFrame:
    """func, src, dst: saturating count; tests has every test that has the arc in its graph, taken or not."""
    return arcs.groupBy("func", "src", "dst").agg(saturating_sum("count").alias("count"), F.sort_array(F.collect_set("test")).alias("tests"))


def block_counts(arcs: DataFrame) -> DataFrame:
    """func, block, count: what flows in; for block 0 what flows out. Blocks of no arc have no row."""
    ins = arcs.select("func", F.col("dst").alias("block"), F.when(F.col("dst") != 0, F.col("count")).alias("count"))
    outs = arcs.select("func", F.col("src").alias("block"), F.when(F.col("src") == 0, F.col("count")).alias("count"))
    return ins.unionByName(outs).groupBy("func", "block").agg(F.coalesce(saturating_sum("count"), F.lit(0).cast(COUNT)).alias("count"))


def entered_blocks(arcs: DataFrame) -> DataFrame:
    """func, block, entered; a block that isn't in the graph has no row."""
    return block_counts(arcs).select("func", "block", (F.col("count") > 0).alias("entered"))


def lines_reached(entered: DataFrame, block_line: DataFrame) -> DataFrame:
    """file, line, reached: whether any block that carries the line was entered; lines of no block have no row."""
    return block_line.join(entered, ["func", "block"]).groupBy("file", "line").agg(F.max("entered").alias("reached"))


def function_groups(functions: DataFrame) -> DataFrame:
    """Functions that share a source and a start line with another, artificial ones left out."""
    w = Window.partitionBy("source", "start_line")
    return functions.where(~F.col("artificial")).withColumn("members", F.count("*").over(w)).where("members > 1")


def attributed_lines(groups: DataFrame) -> DataFrame:
    """func, block, file, line: which line each location group of a block stands for, one row a group.

    groups is (func, block, grp, file, lines sorted, last_block). A group stands for its last line; one without lines for the last line
    before it in its block. Entry and exit blocks stand for none.
    """
    w = Window.partitionBy("func", "block").orderBy("grp").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.size("lines") > 0, F.struct("file", F.array_max("lines").alias("line")))
    carried = groups.where("block <> 0 and block <> last_block").withColumn("at", F.last(own, ignorenulls=True).over(w)).where("at is not null")
    return carried.select("func", "block", "grp", "at.file", "at.line")


def graph_inflow(lines: DataFrame, arcs: DataFrame) -> DataFrame:
    """func, file, line, count: what enters the blocks of a line from outside them; a block that a line has twice counts twice.

    lines is attributed_lines(), arcs (func, src, dst, count). Cycles within a line are added by operators.flow.
    """
    into = lines.join(arcs, (lines["func"] == arcs["func"]) & (lines["block"] == arcs["dst"])).select(lines["func"], "file", "line", "src", "count")
    own = lines.select("func", "file", "line", F.col("block").alias("src")).distinct()
    entry = into.join(own, ["func", "file", "line", "src"], "left_anti").groupBy("func", "file", "line").agg(saturating_sum("count").alias("entered"))
    every = lines.select("func", "file", "line").distinct()
    return every.join(entry, ["func", "file", "line"], "left").select("func", "file", "line", F.coalesce("entered", F.lit(0).cast(COUNT)).alias("count"))


def variants(sets: DataFrame) -> DataFrame:
    """variant: every build that contributed."""
    return sets.select("variant").distinct()


def tests_seen(records: DataFrame) -> DataFrame:
    """test: every test that contributed, executed lines or not."""
    return records.where("test is not null").select("test").distinct()


def tests_for_spans(sets: DataFrame, spans: DataFrame, expansion: DataFrame) -> DataFrame:
    """ask, tests for spans (ask, file, lo, hi, tu, ctx): all lines of a span, or of its outermost call site inside an expansion.

    expansion is (tu, ctx, parent, file, line). Null only if none of the lines is recorded.
    """
    node = F.struct("tu", "ctx")
    up = roots(expansion.select(node.alias("node"), F.when(F.col("parent").isNotNull(), F.struct("tu", F.col("parent").alias("ctx"))).alias("parent")))
    sites = up.join(expansion.select(node.alias("root"), F.col("file").alias("at"), "line"), "root").select("node.tu", "node.ctx", "at", "line")
    written = spans.where("ctx is null").select("ask", "file", "lo", "hi")
    inside = spans.where("ctx is not null").select("ask", "tu", "ctx").join(sites, ["tu", "ctx"], "left").select("ask", F.col("at").alias("file"), F.col("line").alias("lo"), F.col("line").alias("hi"))
    return tests_for_ranges(sets, written.unionByName(inside))


def compact_sets(sets: DataFrame) -> DataFrame:
    """file, line, bucket, bits: the tests (whole numbers) of each line as bitmaps, one for each 32,768 of them that any executed."""
    each = sets.select("file", "line", F.explode("tests").alias("test"))
    return each.groupBy("file", "line", F.bitmap_bucket_number("test").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("test")).alias("bits"))


def compact_union(compact: DataFrame, asked: DataFrame) -> DataFrame:
    """ask, n_tests: how many tests executed any of the lines (ask, file, line), by joining bitmaps, without listing a test."""
    found = asked.join(compact, ["file", "line"]).groupBy("ask", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    return asked.select("ask").distinct().join(found.groupBy("ask").agg(F.sum("n").alias("n")), "ask", "left").select("ask", F.coalesce("n", F.lit(0)).cast("long").alias("n_tests"))
