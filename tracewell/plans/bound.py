"""The operators bound to the driver's tables by role, each with the SQL that DuckDB answers the same.

The bindings exercise generic operators; they don't claim that a lineitem is a line of code. Sets are shown as
comma-joined text, in which null (unrecorded) and '' (recorded, empty) differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.envelope import determinism_key
from tracewell.functions import bits, domains, literals
from tracewell.functions.facts import saturating_sum
from tracewell.functions.paths import basename, glob_match, normalized
from tracewell.operators import builds, constraints, coverage, findings, fixpoint, graphs, impact, intervals, layout, recipes, selection, sites, sweep

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(tests: str = "tests") -> Column:
    return F.array_join(F.col(tests).cast("array<string>"), ",").alias(tests)


# Coverage ----------------------------------------------------------------------------------------------------------

REC = """rec AS (SELECT l_suppkey AS file, l_partkey AS line, l_orderkey % 97 AS test, l_returnflag AS variant,
  CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS count FROM lineitem)"""
TESTS_OF = f"""{REC}, tests_of AS (SELECT file, line, coalesce(list(DISTINCT test) FILTER (WHERE count > 0), []) AS tests FROM rec GROUP BY file, line)"""
TEST = f"""{REC}, test AS (SELECT o_orderkey AS test, CASE o_orderstatus WHEN 'F' THEN 'Passed' WHEN 'O' THEN 'Crashed' ELSE 'Failed' END AS outcome,
  o_orderkey IN (SELECT test FROM rec) AS ingested FROM orders)"""
TEXT = "array_to_string(list_sort({}), ',')"


def records(spark: SparkSession, d: str) -> DataFrame:
    count = F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("long")).otherwise(0)
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("line"), (F.col("l_orderkey") % 97).alias("test"), F.col("l_returnflag").alias("variant"), count.alias("count"))


def sets(spark: SparkSession, d: str) -> DataFrame:
    return coverage.coverage_sets(records(spark, d))


def tests(spark: SparkSession, d: str) -> DataFrame:
    known = records(spark, d).select("test").distinct().withColumn("ingested", F.lit(True))
    outcome = F.when(F.col("o_orderstatus") == "F", "Passed").when(F.col("o_orderstatus") == "O", "Crashed").otherwise("Failed")
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("test"), outcome.alias("outcome"))
    return t.join(known, "test", "left").withColumn("ingested", F.coalesce("ingested", F.lit(False)))


@query("line_count", f"WITH {REC} SELECT file, line, CAST(sum(count) AS BIGINT) AS count FROM rec GROUP BY file, line")
def _(spark, d):
    return coverage.line_count(sets(spark, d)).withColumn("count", F.col("count").cast("long"))


@query("lines_of", f"WITH {REC} SELECT DISTINCT line FROM rec WHERE file = 3")
def _(spark, d):
    return coverage.lines_of(sets(spark, d), 3)


@query("uncovered_lines", f"WITH {REC} SELECT file, line FROM rec GROUP BY file, line HAVING sum(count) = 0")
def _(spark, d):
    return coverage.uncovered_lines(sets(spark, d))


@query("tests_for_line", f"WITH {TESTS_OF} SELECT file, line, {TEXT.format('tests')} AS tests FROM tests_of")
def _(spark, d):
    return coverage.tests_for_lines(sets(spark, d)).select("file", "line", shown())


@query("tests_for_line_in", f"WITH {REC} SELECT file, line, {TEXT.format('coalesce(list(DISTINCT test) FILTER (WHERE count > 0), [])')} AS tests FROM rec WHERE variant = 'R' GROUP BY file, line")
def _(spark, d):
    return coverage.tests_for_lines_in(sets(spark, d), "R").select("file", "line", shown())


@query(
    "tests_for_lines_union",
    f"""WITH {REC}, asked AS (SELECT p_partkey % 300 AS ask, p_partkey % 10 AS file, p_partkey AS line FROM part)
SELECT ask, CASE WHEN bool_or(rec.file IS NOT NULL) THEN {TEXT.format('coalesce(list(DISTINCT test) FILTER (WHERE count > 0), [])')} END AS tests
FROM asked LEFT JOIN rec ON rec.file = asked.file AND rec.line = asked.line GROUP BY ask""",
)
def _(spark, d):
    asked = table(spark, d, "part").select((F.col("p_partkey") % 300).alias("ask"), (F.col("p_partkey") % 10).alias("file"), F.col("p_partkey").alias("line"))
    return coverage.tests_for_asked(sets(spark, d), asked).select("ask", shown())


@query(
    "tests_for_range",
    f"""WITH {REC}, asked AS (SELECT c_custkey AS ask, c_custkey % 10 AS file, c_custkey AS lo, c_custkey + c_nationkey AS hi FROM customer)
SELECT ask, CASE WHEN bool_or(rec.file IS NOT NULL) THEN {TEXT.format('coalesce(list(DISTINCT test) FILTER (WHERE count > 0), [])')} END AS tests
FROM asked LEFT JOIN rec ON rec.file = asked.file AND rec.line BETWEEN lo AND hi GROUP BY ask""",
)
def _(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("ask"), (F.col("c_custkey") % 10).alias("file"), F.col("c_custkey").alias("lo"), (F.col("c_custkey") + F.col("c_nationkey")).alias("hi"))
    return coverage.tests_for_ranges(sets(spark, d), asked).select("ask", shown())


@query(
    "tests_for_block",
    f"""WITH {REC}, asked AS (SELECT p_size AS block, p_partkey % 7 AS file, p_partkey AS line FROM part)
SELECT block, CASE WHEN bool_or(rec.file IS NOT NULL) THEN {TEXT.format('coalesce(list(DISTINCT test) FILTER (WHERE count > 0), [])')} END AS tests
FROM asked LEFT JOIN rec ON rec.file = asked.file AND rec.line = asked.line GROUP BY block""",
)
def _(spark, d):
    blocks = table(spark, d, "part").groupBy(F.col("p_size").alias("block")).agg(F.collect_list(F.struct((F.col("p_partkey") % 7).alias("file"), F.col("p_partkey").alias("line"))).alias("lines"))
    return coverage.tests_for_blocks(sets(spark, d), blocks).select("block", shown())


@query("files", "SELECT l_suppkey AS file, min(l_orderkey * 8 + l_linenumber) AS ord FROM lineitem GROUP BY 1")
def _(spark, d):
    return coverage.files(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord")))


@query("coverage_complete", f"WITH {TEST} SELECT test, coalesce(outcome IN ('Passed', 'Failed') AND ingested, false) AS complete FROM test")
def _(spark, d):
    return tests(spark, d).select("test", coverage.coverage_complete().alias("complete"))


@query("always_run", f"WITH {TEST} SELECT test FROM test WHERE NOT (outcome IN ('Passed', 'Failed') AND ingested)")
def _(spark, d):
    return coverage.always_run(tests(spark, d))


@query(
    "validity",
    f"""WITH {TEST}, f AS (SELECT list(doc_id) FILTER (WHERE doc_id % 17 = 0 OR doc_id % 23 = 0) AS files FROM documents),
t AS (SELECT list(test) AS tests FROM test WHERE NOT (outcome IN ('Passed', 'Failed') AND ingested))
SELECT CASE WHEN len(files) > 0 THEN 'Stale' WHEN len(tests) > 0 THEN 'Partial' ELSE 'Fresh' END AS state, {TEXT.format('files')} AS files, {TEXT.format('tests')} AS tests FROM f, t""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text")
    now = docs.where("file % 23 <> 0").select("file", F.sha2(F.when(F.col("file") % 17 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("hash"))
    return coverage.validity(docs.select("file", F.sha2("text", 256).alias("hash")), now, tests(spark, d)).select("state", shown("files"), shown())


@query("validity_partial", f"WITH {TEST}, t AS (SELECT list(test) AS tests FROM test WHERE NOT (outcome IN ('Passed', 'Failed') AND ingested)) SELECT CASE WHEN len(tests) > 0 THEN 'Partial' ELSE 'Fresh' END AS state, '' AS files, {TEXT.format('tests')} AS tests FROM t")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.sha2("text", 256).alias("hash"))
    return coverage.validity(docs, docs, tests(spark, d)).select("state", shown("files"), shown())


@query("detail_min", "SELECT CASE WHEN bool_and(o_orderstatus = 'F') THEN 'LinesAndArcs' ELSE 'Lines' END AS detail FROM orders")
def _(spark, d):
    return coverage.detail(table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "LinesAndArcs").otherwise("Lines").alias("detail")))


@query(
    "object_merge",
    """WITH p AS (SELECT l_orderkey % 13 AS object, l_suppkey AS file, l_partkey % 50 AS line, l_returnflag AS k, CAST(l_quantity AS BIGINT) AS c FROM lineitem),
o AS (SELECT object, file, line, coalesce(sum(c) FILTER (WHERE k = 'A'), sum(c) FILTER (WHERE k = 'N'), 0) + coalesce(sum(c) FILTER (WHERE k = 'R'), 0) AS count FROM p GROUP BY ALL)
SELECT file, line, CAST(sum(count) AS BIGINT) AS count FROM o GROUP BY file, line""",
)
def _(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "graphed").when(F.col("l_returnflag") == "N", "accumulated").otherwise("private")
    parts = table(spark, d, "lineitem").select((F.col("l_orderkey") % 13).alias("object"), F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 50).alias("line"), kind.alias("kind"), F.col("l_quantity").cast("long").alias("count"))
    return coverage.merged_over_objects(coverage.merged_in_object(parts)).withColumn("count", F.col("count").cast("long"))


@query("saturating_sum", "SELECT l_suppkey AS file, CAST(least(sum(CAST(l_quantity AS HUGEINT) * 10000000000000000), 18446744073709551615::HUGEINT) AS VARCHAR) AS count FROM lineitem GROUP BY 1")
def _(spark, d):
    big = F.col("l_quantity").cast("decimal(18,0)") * F.lit(10_000_000_000_000_000).cast("decimal(18,0)")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("file")).agg(saturating_sum(big).cast("string").alias("count"))


ARC = """arc AS (SELECT o_custkey % 50 AS func, o_orderkey % 7 AS src, o_orderkey % 5 AS dst, o_orderkey % 4 AS flags, o_orderkey % 97 AS test,
  CASE WHEN o_orderstatus = 'O' THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS count, o_orderkey AS arc_ix FROM orders),
real AS (SELECT * FROM arc WHERE flags & 2 = 0),
block AS (SELECT func, block, CAST(coalesce(sum(count), 0) AS BIGINT) AS count FROM (SELECT func, dst AS block, CASE WHEN dst <> 0 THEN count END AS count FROM real
  UNION ALL SELECT func, src, CASE WHEN src = 0 THEN count END FROM real) GROUP BY func, block)"""


def arcs(spark: SparkSession, d: str) -> DataFrame:
    count = F.when(F.col("o_orderstatus") == "O", 0).otherwise(F.floor("o_totalprice").cast("long"))
    return table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("func"), (F.col("o_orderkey") % 7).alias("src"), (F.col("o_orderkey") % 5).alias("dst"), (F.col("o_orderkey") % 4).alias("flags"), (F.col("o_orderkey") % 97).alias("test"), count.alias("count"), F.col("o_orderkey").alias("arc_ix"))


@query("arcs_of", f"WITH {ARC} SELECT func, arc_ix, src, dst FROM real")
def _(spark, d):
    return coverage.real_arcs(arcs(spark, d)).select("func", "arc_ix", "src", "dst")


@query("arc_count", f"WITH {ARC} SELECT func, src, dst, CAST(sum(count) AS BIGINT) AS count, {TEXT.format('list(DISTINCT test)')} AS tests FROM real GROUP BY func, src, dst")
def _(spark, d):
    return coverage.merged_arcs(coverage.real_arcs(arcs(spark, d))).select("func", "src", "dst", F.col("count").cast("long").alias("count"), shown())


@query("arc_inflow", f"WITH {ARC} SELECT func, block, count FROM block")
def _(spark, d):
    return coverage.block_counts(coverage.real_arcs(arcs(spark, d))).withColumn("count", F.col("count").cast("long"))


@query("entered_block", f"WITH {ARC} SELECT func, block, count > 0 AS entered FROM block")
def _(spark, d):
    return coverage.entered_blocks(coverage.real_arcs(arcs(spark, d)))


@query("line_reached", f"WITH {ARC} SELECT p_size AS file, p_partkey AS line, bool_or(count > 0) AS reached FROM part JOIN block ON func = p_partkey % 50 AND block = p_partkey % 7 GROUP BY 1, 2")
def _(spark, d):
    lines = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("func"), (F.col("p_partkey") % 7).alias("block"), F.col("p_size").alias("file"), F.col("p_partkey").alias("line"))
    return coverage.lines_reached(coverage.entered_blocks(coverage.real_arcs(arcs(spark, d))), lines)


@query("function_groups", "SELECT p_partkey AS func, n AS members FROM (SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part WHERE p_partkey % 9 <> 0) WHERE n > 1")
def _(spark, d):
    f = table(spark, d, "part").select(F.col("p_partkey").alias("func"), F.col("p_brand").alias("source"), F.col("p_size").alias("start_line"), (F.col("p_partkey") % 9 == 0).alias("artificial"))
    return coverage.function_groups(f).select("func", "members")


# Impact ------------------------------------------------------------------------------------------------------------

KINDS_SQL = "CASE p_partkey % 6 WHEN 0 THEN 'Function' WHEN 1 THEN 'Global' WHEN 2 THEN 'Typedef' WHEN 3 THEN 'Record' WHEN 4 THEN 'EnumConst' ELSE 'Macro' END"
DIFF = f"""old AS (SELECT {KINDS_SQL} AS kind, p_brand AS file, p_name || p_partkey AS name, p_type AS head, CASE WHEN p_partkey % 2 = 0 THEN '{{' ELSE '=' END AS lead, p_size AS tail FROM part),
new AS (SELECT {KINDS_SQL} AS kind, p_brand AS file, p_name || p_partkey AS name, CASE WHEN p_partkey % 23 = 0 THEN 'X' ELSE p_type END AS head, CASE WHEN p_partkey % 2 = 0 THEN '{{' ELSE '=' END AS lead,
  p_size + CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS tail FROM part WHERE p_partkey % 17 <> 0
  UNION ALL SELECT {KINDS_SQL}, p_brand, p_name || (p_partkey + 1000000), p_type, '{{', p_size FROM part WHERE p_partkey % 19 = 0),
class AS (SELECT kind, file, name, CASE WHEN old.head IS NULL THEN 'Added' WHEN new.head IS NULL THEN 'Removed'
  WHEN kind = 'Macro' THEN CASE WHEN old.head <> new.head THEN 'MacroInterfaceChanged' WHEN old.tail <> new.tail THEN 'MacroBodyChanged' END
  WHEN old.head <> new.head THEN 'SignatureChanged' WHEN old.tail <> new.tail THEN CASE WHEN new.lead = '{{' THEN 'BodyChanged' ELSE 'InitializerChanged' END END AS class
  FROM old FULL JOIN new USING (kind, file, name))"""


def _entities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, d, "part")
    key = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("Function", "Global", "Typedef", "Record", "EnumConst", "Macro"))), (key % 6 + 1).cast("int"))

    def side(rows: DataFrame, name: Column, head: Column, lead: Column, tail: Column) -> DataFrame:
        return rows.select(kind.alias("kind"), F.col("p_brand").alias("file"), F.concat("p_name", name).alias("name"), F.array(head).alias("head"), F.array(lead, tail.cast("string")).alias("tail"))

    lead = F.when(key % 2 == 0, "{").otherwise("=")
    old = side(part, key, F.col("p_type"), lead, F.col("p_size"))
    new = side(part.where(key % 17 != 0), key, F.when(key % 23 == 0, "X").otherwise(F.col("p_type")), lead, F.col("p_size") + F.when(key % 10 == 0, 1).otherwise(0))
    return old, new.unionByName(side(part.where(key % 19 == 0), key + 1_000_000, F.col("p_type"), F.lit("{"), F.col("p_size")))


@query("entity_diff", f"WITH {DIFF} SELECT kind, file, name, class FROM class WHERE class IS NOT NULL")
def _(spark, d):
    return impact.classified(impact.entity_diff(*_entities(spark, d))).select("kind", "file", "name", "class")


@query("class_tree", f"WITH {DIFF} SELECT kind, class, count(*) AS n FROM class WHERE class IS NOT NULL GROUP BY kind, class")
def _(spark, d):
    return impact.classified(impact.entity_diff(*_entities(spark, d))).groupBy("kind", "class").agg(F.count("*").alias("n"))


@query(
    "record_class",
    """WITH f AS (SELECT p_partkey // 8 AS tag, p_partkey % 8 AS name, (p_partkey % 8) * 12 AS o, (p_partkey % 8) * 12 + CASE WHEN p_partkey % 40 = 0 THEN 4 ELSE 0 END AS n FROM part)
SELECT tag, bool_or(o <> n) OR tag % 7 = 0 AS layout, CAST(CASE WHEN tag % 7 = 0 THEN 8 ELSE 0 END AS BIGINT) AS size_delta FROM f GROUP BY tag""",
)
def _(spark, d):
    part = table(spark, d, "part")
    tag, ord_ = F.floor(F.col("p_partkey") / 8), F.col("p_partkey") % 8
    none = F.lit(None).cast("long")
    rec = part.select(tag.alias("tag")).distinct()
    shape = lambda extra: rec.select("tag", (F.lit(96) + extra).cast("long").alias("size"), F.lit(8).alias("align"), F.lit(False).alias("is_union"))
    field = lambda off: part.select(tag.alias("tag"), ord_.alias("name"), off.alias("offset"), none.alias("bit_offset"), none.alias("bit_width"))
    return impact.record_changes(shape(F.lit(0)), shape(F.when(F.col("tag") % 7 == 0, 8).otherwise(0)), field(ord_ * 12), field(ord_ * 12 + F.when(F.col("p_partkey") % 40 == 0, 4).otherwise(0)))


@query(
    "condition_zip",
    """WITH a AS (SELECT o_custkey AS key, o_orderpriority AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders),
b AS (SELECT o_custkey AS key, o_orderpriority AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders WHERE o_orderkey % 11 <> 0)
SELECT a.key, CAST(a.pos AS INTEGER) AS pos, a.v AS old, b.v AS new FROM a LEFT JOIN b ON a.key = b.key AND a.pos = b.pos
WHERE a.v IS DISTINCT FROM b.v AND a.key IN (SELECT key FROM b)""",
)
def _(spark, d):
    orders = table(spark, d, "orders")
    listed = lambda rows: F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["v"])
    row = F.struct("o_orderkey", F.col("o_orderpriority").alias("v"))
    kept = F.when(F.col("o_orderkey") % 11 != 0, row)
    pairs = orders.groupBy(F.col("o_custkey").alias("key")).agg(listed(row).alias("old"), listed(kept).alias("new")).where(F.size("new") > 0)
    return impact.zipped_conditions(pairs)


EDGE = "edge AS (SELECT DISTINCT o_custkey AS src, CAST(floor(o_totalprice) AS BIGINT) % (SELECT count(*) FROM customer) AS dst FROM orders WHERE o_orderpriority = '1-URGENT')"
REACH = f"{EDGE}, r(node) AS (SELECT range FROM range(3) UNION SELECT dst FROM r JOIN edge ON src = node)"
DEPTH = f"{EDGE}, r(node, distance) AS (SELECT range, 0 FROM range(3) UNION SELECT dst, distance + 1 FROM r JOIN edge ON src = node WHERE distance < 40)"


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    urgent, n = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), table(spark, d, "customer").count()
    return spark.range(3).withColumnRenamed("id", "node"), urgent.select(F.col("o_custkey").alias("src"), (F.floor("o_totalprice").cast("long") % n).alias("dst"), F.col("o_orderkey").alias("ord"))


@query("impact_closure", f"WITH RECURSIVE {REACH} SELECT node FROM r")
def _(spark, d):
    return fixpoint.reached(*_edges(spark, d)).select("node")


@query("impact_distance", f"WITH RECURSIVE {DEPTH} SELECT node, CAST(min(distance) AS INTEGER) AS distance FROM r GROUP BY node")
def _(spark, d):
    return fixpoint.reached(*_edges(spark, d))


@query("impact_set")
def _(spark, d):
    """Classes, roots and paths: the tie-breaks are tested against a brute-force version."""
    changed = impact.classified(impact.entity_diff(*_entities(spark, d)))
    part = table(spark, d, "part")
    name = lambda c: F.concat("p_name", c)
    key = F.col("p_partkey")
    edges = part.select(F.lit("Function").alias("kind"), F.col("p_brand").alias("file"), name(key).alias("name"), F.concat("p_name", (key - key % 7 + 3)).alias("mentioned"), key.alias("ord"))
    return impact.impact(changed, edges).select("kind", "file", "name", "class", F.col("root.name").alias("root"), F.array_join("path", ">").alias("path"), "distance")


@query(
    "address_taken_theta",
    """WITH f AS (SELECT c_name AS callee, c_nationkey % 5 AS params, c_custkey % 7 = 0 AS any_more FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0)
SELECT o_orderkey AS name, min(callee) AS callee, 1 AS distance FROM orders JOIN f ON o_orderkey % 6 = params OR (any_more AND o_orderkey % 6 >= params) GROUP BY 1""",
)
def _(spark, d):
    customer = table(spark, d, "customer")
    f = customer.where("c_mktsegment = 'BUILDING'").select(F.lit("Function").alias("kind"), F.lit("f.c").alias("file"), F.col("c_name").alias("name"))
    arity = customer.select(F.col("c_name").alias("name"), (F.col("c_nationkey") % 5).alias("params"), (F.col("c_custkey") % 7 == 0).alias("variadic"))
    taken = customer.where("c_acctbal > 0").select(F.col("c_name").alias("name"))
    holders = table(spark, d, "orders").select(F.lit("Function").alias("kind"), F.lit("g.c").alias("file"), F.col("o_orderkey").alias("name"), (F.col("o_orderkey") % 6).cast("int").alias("args"))
    return impact.indirect_holders(f, holders, arity, taken).select("name", "callee", "distance")


@query("completeness", "SELECT c_nationkey, CASE WHEN count(*) FILTER (WHERE c_acctbal < -950) = 0 THEN 'Complete' ELSE 'Partial' END AS state, count(*) FILTER (WHERE c_acctbal < -950) AS gaps FROM customer GROUP BY 1")
def _(spark, d):
    gaps = table(spark, d, "customer").select("c_nationkey", F.when(F.col("c_acctbal") < -950, F.col("c_name")).alias("gap"))
    return impact.completeness(gaps, ["c_nationkey"])


@query("components", f"WITH RECURSIVE {EDGE}, e AS (SELECT src AS a, dst AS b FROM edge UNION SELECT dst, src FROM edge), r(node, seen) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node")
def _(spark, d):
    edges = _edges(spark, d)[1]
    return fixpoint.connected(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))


# Selection ---------------------------------------------------------------------------------------------------------

CHOICE = f"""{TESTS_OF}, imp AS (SELECT p_partkey % 100 AS file, p_name || p_partkey AS name, p_partkey AS line, p_partkey % 4 AS distance, p_size < 48 AS proven FROM part),
hit AS (SELECT unnest(t.tests) AS test, imp.file, name, distance, proven FROM imp JOIN tests_of t ON t.file = imp.file AND t.line = imp.line),
test AS (SELECT o_orderkey AS test, CASE o_orderstatus WHEN 'F' THEN 'Passed' WHEN 'O' THEN 'Crashed' ELSE 'Failed' END AS outcome, o_orderkey IN (SELECT test FROM rec) AS ingested FROM orders),
safe AS (SELECT test, 'no complete coverage' AS why FROM test WHERE NOT (outcome IN ('Passed', 'Failed') AND ingested)
  UNION SELECT test, 'no line attributed' FROM test WHERE ingested AND test NOT IN (SELECT unnest(tests) FROM tests_of)
  UNION SELECT o_orderkey, 'never measured' FROM orders WHERE o_orderkey NOT IN (SELECT test FROM test WHERE ingested)),
cov AS (SELECT test, min(distance) AS distance, file, name FROM hit GROUP BY test, file, name),
chosen AS (SELECT test, coalesce(min(distance), 2147483647) AS score, count(*) AS n_reasons, bool_and(distance IS NULL) AS only_always
  FROM (SELECT test, distance, name || file AS why FROM cov UNION ALL SELECT test, NULL, why FROM safe) GROUP BY test),
ranked AS (SELECT *, row_number() OVER (ORDER BY score, test) AS rank FROM chosen)"""


def _choice(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    part = table(spark, d, "part")
    key = F.col("p_partkey")
    entity = [F.lit("Function").alias("kind"), (key % 100).alias("file"), F.concat("p_name", key).alias("name")]
    found = {"impacted": part.select(*entity, (key % 4).cast("int").alias("distance")), "lines": part.select(*entity, key.alias("line")), "tests_of": coverage.tests_for_lines(sets(spark, d)), "tests": tests(spark, d)}
    found["verdicts"] = part.where("p_size < 48").select(*entity, F.lit("Equivalent").alias("verdict"), F.lit("exact").alias("fidelity"))
    found["suite"] = table(spark, d, "orders").select(F.col("o_orderkey").alias("test"))
    return found


def _chosen(c: dict[str, DataFrame], impacted: DataFrame) -> DataFrame:
    return selection.selected(selection.covered_by(impacted, c["lines"], c["tests_of"]).unionByName(selection.safety_set(c["tests"], c["tests_of"], c["suite"])))


@query("select_join", f"WITH {CHOICE} SELECT test, count(*) AS entities, CAST(min(distance) AS INTEGER) AS distance FROM cov GROUP BY test")
def _(spark, d):
    c = _choice(spark, d)
    return selection.covered_by(c["impacted"], c["lines"], c["tests_of"]).groupBy("test").agg(F.count("*").alias("entities"), F.min("distance").alias("distance"))


@query(
    "select_unmatched",
    f"""WITH {CHOICE} SELECT imp.name, CASE WHEN imp.file NOT IN (SELECT file FROM tests_of) THEN 'file not in index' ELSE 'no coverage' END AS why
FROM imp WHERE NOT EXISTS (SELECT 1 FROM tests_of t WHERE t.file = imp.file AND t.line = imp.line)""",
)
def _(spark, d):
    c = _choice(spark, d)
    return selection.unmatched(c["impacted"], c["lines"], c["tests_of"]).select("name", "why")


@query("select_safety", f"WITH {CHOICE} SELECT test, why FROM safe")
def _(spark, d):
    c = _choice(spark, d)
    return selection.safety_set(c["tests"], c["tests_of"], c["suite"]).select("test", "why")


@query("select_rank", f"WITH {CHOICE} SELECT test, CAST(score AS INTEGER) AS score, n_reasons, only_always, CAST(rank AS INTEGER) AS rank FROM ranked")
def _(spark, d):
    c = _choice(spark, d)
    return selection.ranked(_chosen(c, c["impacted"]))


@query("select_budget", f"WITH {CHOICE} SELECT test, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 20")
def _(spark, d):
    c = _choice(spark, d)
    return selection.within_budget(selection.ranked(_chosen(c, c["impacted"])), 20).select("test", "rank")


@query("select_budget_effect", f"WITH {CHOICE} SELECT count(*) FILTER (WHERE rank <= 20) AS kept, count(*) FILTER (WHERE rank > 20) AS dropped, CASE WHEN count(*) > 20 THEN 'Reduced' ELSE 'Full' END AS confidence FROM ranked")
def _(spark, d):
    c = _choice(spark, d)
    return selection.budget_effect(selection.ranked(_chosen(c, c["impacted"])), 20)


@query("select_excluded", f"WITH {CHOICE} SELECT test, min('Function:' || file || ':' || name) AS entity FROM hit WHERE proven AND test NOT IN (SELECT test FROM hit WHERE NOT proven) AND test NOT IN (SELECT test FROM safe) GROUP BY test")
def _(spark, d):
    c = _choice(spark, d)
    left, proven = selection.refined(c["impacted"], c["verdicts"])
    return selection.excluded(proven, c["lines"], c["tests_of"], _chosen(c, left))


@query(
    "recall_reduction",
    """WITH need AS (SELECT DISTINCT o_custkey AS mutation, o_orderkey % 97 AS test FROM orders WHERE o_orderstatus = 'F'),
got AS (SELECT DISTINCT o_custkey AS mutation, o_orderkey % 97 AS test FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 100000),
b AS (SELECT mutation, need.test IS NOT NULL AS n, got.test IS NOT NULL AS g FROM need FULL JOIN got USING (mutation, test))
SELECT count(*) FILTER (WHERE n) AS required, count(*) FILTER (WHERE n AND g) AS hit, count(*) FILTER (WHERE n AND g) / count(*) FILTER (WHERE n) AS recall, count(*) FILTER (WHERE g) AS n_selected,
(count(DISTINCT mutation) * 97 - count(*) FILTER (WHERE g)) / (count(DISTINCT mutation) * 97) AS reduction FROM b""",
)
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("mutation"), (F.col("o_orderkey") % 97).alias("test"), "o_orderstatus", "o_totalprice")
    return selection.recall(o.where("o_orderstatus = 'F'").select("mutation", "test"), o.where("o_orderstatus <> 'P' and o_totalprice > 100000").select("mutation", "test"), 97)


@query("baseline_selection", f"WITH {TESTS_OF} SELECT DISTINCT p_partkey % 8 AS mutation, unnest(tests) AS test FROM part JOIN tests_of ON file = p_partkey % 100 AND line = p_partkey")
def _(spark, d):
    lines = table(spark, d, "part").select((F.col("p_partkey") % 8).alias("mutation"), (F.col("p_partkey") % 100).alias("file"), F.col("p_partkey").alias("line"))
    return selection.baseline(lines, coverage.tests_for_lines(sets(spark, d)))


# Expansion, recipes, intervals -----------------------------------------------------------------------------------------

TREE = "tree AS (SELECT p_partkey AS ctx, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 3 END AS parent, p_name AS macro, p_brand AS file, p_size AS line FROM part)"
UP = f"{TREE}, up(ctx, anc, depth) AS (SELECT ctx, ctx, 0 FROM tree UNION ALL SELECT up.ctx, t.parent, depth + 1 FROM up JOIN tree t ON t.ctx = up.anc WHERE t.parent IS NOT NULL)"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    parent = F.when(key > 0, F.floor((key - 1) / 3))
    return table(spark, d, "part").select(F.lit("t").alias("tu"), key.alias("ctx"), parent.alias("parent"), F.col("p_name").alias("macro"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"), (key % 5).alias("col"), (key % 11).alias("item_line"), (key % 3).alias("item_col"))


@query("expansion_depth", f"WITH RECURSIVE {UP} SELECT ctx AS node, arg_max(anc, depth) AS root, CAST(max(depth) AS INTEGER) AS depth FROM up GROUP BY ctx")
def _(spark, d):
    return sites.expansion_depth(_tree(spark, d).select(F.col("ctx").alias("node"), "parent"))


@query(
    "leaf_chains",
    f"""WITH RECURSIVE {UP}, m AS (SELECT ctx FROM tree WHERE line % 5 = 0), leaf AS (SELECT ctx FROM m WHERE ctx NOT IN (SELECT anc FROM up WHERE depth > 0 AND up.ctx IN (SELECT ctx FROM m)))
SELECT up.ctx, array_to_string(list(macro ORDER BY depth), '>') AS chain FROM up JOIN tree ON tree.ctx = anc WHERE up.ctx IN (SELECT ctx FROM leaf) GROUP BY up.ctx""",
)
def _(spark, d):
    tree = _tree(spark, d)
    leaf = sites.leaves_at(tree, tree.where("line % 5 = 0").select("tu", "ctx"))
    return sites.chains(tree, leaf).select("ctx", F.array_join("chain", ">").alias("chain"))


@query("involves_macro", f"WITH RECURSIVE {UP} SELECT up.ctx FROM up JOIN tree ON tree.ctx = anc GROUP BY up.ctx HAVING bool_or(macro = 'cold widget')")
def _(spark, d):
    tree = _tree(spark, d)
    return sites.chains(tree, tree.select("tu", "ctx")).where(sites.involves(F.col("chain"), "cold widget")).select("ctx")


@query("sites_dedup", "SELECT l_suppkey AS macro, l_partkey AS file, l_linenumber AS line, l_returnflag AS config, CAST(min(l_quantity) AS INTEGER) AS depth, count(*) - 1 AS dropped FROM lineitem GROUP BY 1, 2, 3, 4")
def _(spark, d):
    s = table(spark, d, "lineitem").select(F.lit("m.h").alias("macro_file"), F.col("l_suppkey").alias("macro"), F.lit(1).alias("def_line"), F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("config"), F.col("l_quantity").cast("int").alias("depth"))
    return sites.cooked(s).select("macro", "file", "line", "config", "depth", "dropped")


@query("sites_page", "SELECT DISTINCT p_brand AS file, p_size AS line, p_partkey % 5 AS col, p_partkey % 11 AS item_line, p_partkey % 3 AS item_col FROM part WHERE p_name = 'cold widget' ORDER BY ALL LIMIT 20 OFFSET 5")
def _(spark, d):
    return sites.paged(sites.distinct_sites(_tree(spark, d), "cold widget"), sites.PLACE, 5, 20)


@query("lookup_macros", "SELECT p_brand AS def_file, p_partkey AS def_line FROM part WHERE p_brand = 'Brand#13' AND p_name = 'cold widget'")
def _(spark, d):
    m = table(spark, d, "part").select(F.col("p_brand").alias("def_file"), F.col("p_name").alias("name"), F.col("p_partkey").alias("def_line"))
    return sites.definitions(m, "Brand#13", "cold widget").select("def_file", "def_line")


@query("candidates_bounded", f"WITH RECURSIVE {DEPTH}, p AS (SELECT node, min(distance) AS depth FROM r WHERE distance <= 3 GROUP BY node) SELECT CAST(node AS BIGINT) AS node, CAST(depth AS INTEGER) AS depth FROM p UNION ALL SELECT DISTINCT dst, -1 FROM p JOIN edge ON src = node WHERE dst NOT IN (SELECT node FROM p)")
def _(spark, d):
    seeds, edges = _edges(spark, d)
    placed, beyond = fixpoint.reached_in_order(seeds.withColumn("ord", F.col("node")), edges, 3)
    return placed.select("node", "depth").unionByName(beyond.select("node", F.lit(-1).alias("depth")))


RECIPES = [("all", []), ("small", [("name matches", "^small|ring$")]), ("brand", [("in_file", "src/Brand*/?.c")]), ("both", [("name matches", "widget"), ("in_file", "src/**/1.c")]), ("typed", [("registered_via", "X")]), ("mixed", [("name matches", "cold"), ("calls", "f")])]


@query(
    "recipe_tally",
    """WITH f AS (SELECT p_name AS name, 'src/' || p_brand || '/' || (p_size % 12) || '.c' AS file FROM part),
t AS (SELECT count(*) AS c0, count(*) FILTER (WHERE regexp_matches(name, '^small|ring$')) AS c1, count(*) FILTER (WHERE regexp_matches(file, '^src/Brand[^/]*/[^/][.]c$')) AS c2,
  count(*) FILTER (WHERE name LIKE '%widget%' AND file LIKE '%/1.c') AS c3, count(*) AS n4, count(*) FILTER (WHERE name LIKE '%cold%') AS n5 FROM f)
SELECT 0 AS recipe_ix, 'all' AS recipe, c0 AS matched, 0 AS needs_ast FROM t UNION ALL SELECT 1, 'small', c1, 0 FROM t UNION ALL SELECT 2, 'brand', c2, 0 FROM t
UNION ALL SELECT 3, 'both', c3, 0 FROM t UNION ALL SELECT 4, 'typed', 0, n4 FROM t UNION ALL SELECT 5, 'mixed', 0, n5 FROM t""",
)
def _(spark, d):
    f = table(spark, d, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("src/"), "p_brand", F.lit("/"), (F.col("p_size") % 12), F.lit(".c")).alias("file"))
    return recipes.tally(f, RECIPES)


@query("glob_match", "SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://([^/]+/)*en/[^/]*[.]html$')")
def _(spark, d):
    pages = table(spark, d, "pages")
    return pages.where(glob_match(F.col("url"), "http://**/en/*.html") | glob_match(F.col("url"), "https://**/en/*.html")).select("page_id")


@query("path_parts", "SELECT page_id, list_last(string_split(url, '/')) AS name, regexp_replace(url, '/+', '/', 'g') AS path FROM pages WHERE url NOT LIKE '%/'")
def _(spark, d):
    return table(spark, d, "pages").where("url not like '%/'").select("page_id", basename(F.col("url")).alias("name"), normalized(F.col("url")).alias("path"))


@query("interval_join", "SELECT c_custkey, p_partkey FROM customer JOIN part ON c_acctbal >= p_retailprice AND c_acctbal < p_retailprice + p_size % 3 + 0.5")
def _(spark, d):
    k = F.lit(0).alias("k")
    spots = table(spark, d, "customer").select(k, "c_custkey", "c_acctbal")
    bands = table(spark, d, "part").select(k, "p_partkey", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + F.col("p_size") % 3 + 0.5).alias("hi"))
    return intervals.containing(spots, bands, ["k"], "c_acctbal", "lo", "hi", 1.0).select("c_custkey", "p_partkey")


@query("interval_overlap", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND floor(a.s_acctbal) < floor(b.s_acctbal) + 900 AND floor(b.s_acctbal) < floor(a.s_acctbal) + 900")
def _(spark, d):
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.floor("s_acctbal").alias("lo"))
    a = s.select("s_nationkey", F.col("s_suppkey").alias("a"), F.col("lo").alias("alo"), (F.col("lo") + 900).alias("ahi"))
    b = s.select("s_nationkey", F.col("s_suppkey").alias("b"), F.col("lo").alias("blo"), (F.col("lo") + 900).alias("bhi"))
    return intervals.overlapping(a, b, ["s_nationkey"], "alo", "ahi", "blo", "bhi", 500).where("a < b").select("a", "b")


@query("as_of_lookup", "SELECT c_custkey, s_suppkey FROM customer ASOF LEFT JOIN (SELECT s_nationkey, s_acctbal, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1, 2) ON c_nationkey = s_nationkey AND c_acctbal >= s_acctbal")
def _(spark, d):
    starts = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n"), "s_acctbal").agg(F.min("s_suppkey").alias("s_suppkey"))
    spots = table(spark, d, "customer").select(F.col("c_nationkey").alias("n"), "c_custkey", "c_acctbal")
    return intervals.as_of(spots, starts, ["n"], "c_acctbal", "s_acctbal").select("c_custkey", "s_suppkey")


# Layout, findings, sweeps, builds ---------------------------------------------------------------------------------------

FIELD = "f AS (SELECT p_partkey // 8 AS tag, p_partkey % 8 AS ord, p_name || p_partkey AS name, (p_partkey % 8) * 12 AS off, CAST(pow(2, p_size % 4) AS BIGINT) AS size, CAST(floor(p_retailprice) AS BIGINT) AS accesses FROM part)"


def _fields(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = F.col("p_partkey")
    f = table(spark, d, "part").select(F.floor(key / 8).alias("tag"), (key % 8).alias("ord"), F.concat("p_name", key).alias("name"), (key % 8 * 12).alias("offset"), F.pow(F.lit(2), F.col("p_size") % 4).cast("long").alias("size"), F.floor("p_retailprice").cast("long").alias("accesses"))
    r = f.select("tag").distinct().select("tag", F.lit(96).cast("long").alias("size"), F.lit(8).cast("long").alias("align"), F.lit(False).alias("packed"), F.lit(True).alias("fields_complete"), (F.col("tag") % 2 == 0).alias("internal"))
    return f.drop("accesses"), r, f.select("tag", "name", "accesses")


@query("layout_holes", f"WITH {FIELD} SELECT tag, name AS after, lead(name) OVER w AS before, coalesce(lead(off) OVER w, 96) - off - size AS bytes FROM f WINDOW w AS (PARTITION BY tag ORDER BY ord)")
def _(spark, d):
    m, r, _a = _fields(spark, d)
    return layout.holes(m, r)


@query("layout_padding", f"WITH {FIELD} SELECT tag, CAST(ceil(sum(size) / 8) * 8 AS BIGINT) AS packed_size, CAST(96 - ceil(sum(size) / 8) * 8 AS BIGINT) AS recoverable FROM f GROUP BY tag")
def _(spark, d):
    m, r, _a = _fields(spark, d)
    return layout.padding(m, r).select("tag", "packed_size", "recoverable")


@query("layout_straddle", f"WITH {FIELD} SELECT tag, name, CAST((off + size - 1) // 64 * 64 AS BIGINT) AS boundary FROM f WHERE off // 64 <> (off + size - 1) // 64")
def _(spark, d):
    return layout.straddles(_fields(spark, d)[0])


@query("hot_field", f"WITH {FIELD} SELECT tag, name, accesses FROM (SELECT *, max(accesses) OVER (PARTITION BY tag) AS most FROM f) WHERE accesses = most AND off >= 64")
def _(spark, d):
    m, _r, a = _fields(spark, d)
    return layout.hot_fields(m, a)


@query(
    "layout_proposals",
    f"""WITH {FIELD}, hot AS (SELECT tag, name, accesses FROM (SELECT *, max(accesses) OVER (PARTITION BY tag) AS most FROM f) WHERE accesses = most AND off >= 64),
p AS (SELECT tag, 'PaddingWaste' AS kind, NULL AS name, CAST(96 - ceil(sum(size) / 8) * 8 AS BIGINT) AS amount, 'Unquantified' AS benefit FROM f GROUP BY tag
UNION ALL SELECT tag, 'Straddle', name, CAST((off + size - 1) // 64 * 64 AS BIGINT), 'Measured' FROM f WHERE off // 64 <> (off + size - 1) // 64 UNION ALL SELECT tag, 'HotPlacement', name, accesses, 'Measured' FROM hot)
SELECT *, tag % 2 <> 0 AS advisory FROM p""",
)
def _(spark, d):
    return layout.proposals(*_fields(spark, d)).drop("obligation")


@query("bitfield_runs", "WITH b AS (SELECT p_partkey // 8 AS tag, p_partkey % 8 AS ord, p_size % 3 = 0 AS bit FROM part), g AS (SELECT *, sum(CASE WHEN bit AND coalesce(lag_bit, false) THEN 0 ELSE 1 END) OVER (PARTITION BY tag ORDER BY ord) AS run FROM (SELECT *, lag(bit) OVER (PARTITION BY tag ORDER BY ord) AS lag_bit FROM b)) SELECT tag, min(ord) AS ord, CAST(min(ord) * 4 AS BIGINT) AS \"offset\", CAST(CASE WHEN bool_and(bit) THEN max(ord) * 4 + 1 - min(ord) * 4 ELSE 4 END AS BIGINT) AS size FROM g GROUP BY tag, run")
def _(spark, d):
    key = F.col("p_partkey")
    bit = F.col("p_size") % 3 == 0
    f = table(spark, d, "part").select(F.floor(key / 8).alias("tag"), (key % 8).alias("ord"), F.col("p_name").alias("name"), (key % 8 * 4).alias("offset"), F.lit(4).cast("long").alias("size"), F.when(bit, 2).alias("bit_offset"), F.when(bit, 5).alias("bit_width"))
    return layout.effective_members(f).select("tag", "ord", "offset", "size")


@query("finding_group", "SELECT event_type AS kind, user_id AS span, count(*) AS paths, arg_max(props, length(props) * 1000000000 - event_id) AS message, arg_max(event_id, length(props) * 1000000000 - event_id) AS ord FROM events GROUP BY 1, 2")
def _(spark, d):
    f = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("span"), F.col("props").alias("message"), F.col("event_id").alias("ord"))
    return findings.grouped(f, ["kind", "span"])


FINDING = "f AS (SELECT event_id // 2 AS id, event_id % 5 AS state, event_type AS kind, user_id AS file, user_id % 3 AS line, event_id % 4 AS object, event_id % 2 AS func, event_id AS ord FROM events)"


@query("finding_dedup", f"WITH {FINDING}, a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1) SELECT id, ord FROM a QUALIFY row_number() OVER (PARTITION BY state, kind, file, line, object, func ORDER BY ord) = 1")
def _(spark, d):
    e = F.col("event_id")
    f = table(spark, d, "events").select(F.floor(e / 2).alias("id"), (e % 5).alias("state"), F.col("event_type").alias("kind"), F.col("user_id").alias("file"), (F.col("user_id") % 3).alias("line"), (e % 4).alias("object"), (e % 2).alias("func"), e.alias("ord"))
    return findings.deduplicated(f).select("id", "ord")


@query("finding_suppressed", "SELECT count(*) FILTER (WHERE value > 150) AS suppressed FROM events")
def _(spark, d):
    return findings.suppressed(table(spark, d, "events").select((F.col("value") > 150).alias("invented_bound")))


@query("worst_fidelity", "SELECT CASE WHEN bool_or(event_type = 'error') THEN 'unknown' ELSE 'bounded' END AS fidelity FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    return findings.worst_fidelity(e.select(F.when(F.col("event_id") % 2 == 0, "exact").otherwise("bounded").alias("fidelity"), (F.col("event_type") == "error").alias("errored")))


@query("first_seen", "SELECT event_type, min(event_id) AS first FROM events GROUP BY 1")
def _(spark, d):
    return findings.first_seen(table(spark, d, "events"), "event_type", "event_id")


@query(
    "witness_digest",
    """WITH b AS (SELECT user_id AS finding, event_id AS ord, event_type AS label, value > 150 AS pinned, count(*) OVER (PARTITION BY user_id) AS n FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY finding ORDER BY CASE WHEN n > 5 AND NOT pinned THEN 1 ELSE 0 END, ord) AS r FROM b),
cut AS (SELECT finding, label, count(*) AS k FROM r WHERE r > 5 GROUP BY 1, 2)
SELECT finding, array_to_string(list(ord ORDER BY r) FILTER (WHERE r <= 5), ',') AS shown, count(*) FILTER (WHERE r > 5) AS omitted, count(*) FILTER (WHERE r > 5 AND pinned) AS pinned_omitted,
(SELECT string_agg(label || '=' || k, ',' ORDER BY k DESC, label) FROM cut WHERE cut.finding = r.finding) AS labels FROM r GROUP BY finding""",
)
def _(spark, d):
    b = table(spark, d, "events").select(F.col("user_id").alias("finding"), F.col("event_id").alias("ord"), F.col("event_type").alias("label"), (F.col("value") > 150).alias("pinned"))
    labels = F.array_join(F.transform("omitted_by_label", lambda x: F.concat(x["label"], F.lit("="), x["n"])), ",")
    return findings.witness_digest(b, 5).select("finding", shown("shown"), "omitted", "pinned_omitted", labels.alias("labels"))


@query("reachability", "WITH a AS (SELECT c_custkey AS ask, c_custkey % 30 AS file, c_nationkey AS line FROM customer), l AS (SELECT p_size AS file, p_partkey % 25 AS line, p_partkey AS block FROM part), t AS (SELECT DISTINCT l_partkey AS block FROM lineitem WHERE l_quantity = 50) SELECT ask, CASE WHEN count(l.block) = 0 THEN 'no_such_line' WHEN count(t.block) > 0 THEN 'reachable' ELSE 'not_shown_reachable' END AS verdict FROM a LEFT JOIN l USING (file, line) LEFT JOIN t ON t.block = l.block GROUP BY ask")
def _(spark, d):
    func = F.lit("f").alias("func")
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("ask"), (F.col("c_custkey") % 30).alias("file"), F.col("c_nationkey").alias("line"))
    carried = table(spark, d, "part").select(func, F.col("p_partkey").alias("block"), F.col("p_size").alias("file"), (F.col("p_partkey") % 25).alias("line"))
    return findings.reachability(asked, carried, table(spark, d, "lineitem").where("l_quantity = 50").select(func, F.col("l_partkey").alias("block")), F.lit(False))


@query("heap_leaks", f"WITH RECURSIVE {REACH} SELECT c_custkey AS object FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT node FROM r)")
def _(spark, d):
    seeds, edges = _edges(spark, d)
    objects = table(spark, d, "customer").select(F.col("c_custkey").alias("object"), F.lit(True).alias("heap"), (F.col("c_custkey") % 2 == 0).alias("live"))
    return findings.leaks(objects, edges, seeds)


@query("token_mismatch", "SELECT o_custkey AS unit, min(o_orderkey) AS pos FROM orders WHERE o_orderkey % 7 = 0 GROUP BY 1")
def _(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("text"))
    return findings.token_mismatch(a, a.withColumn("text", F.when(F.col("pos") % 7 == 0, "x").otherwise(F.col("text")))).select("unit", "pos")


OUTCOME = """v AS (SELECT o_orderkey AS path, CASE o_orderpriority WHEN '1-URGENT' THEN 'Clean' WHEN '2-HIGH' THEN 'Warned' WHEN '3-MEDIUM' THEN 'Diagnosed' WHEN '4-NOT SPECIFIED' THEN 'Advised' ELSE 'NotRun' END AS theirs,
  CASE WHEN o_custkey % 7 = 0 THEN 'NotRun' WHEN o_custkey % 7 = 1 THEN 'Diagnosed' WHEN o_custkey % 7 = 2 THEN 'Advised' WHEN o_orderstatus = 'F' THEN 'Clean' ELSE 'Warned' END AS ours, o_orderstatus || ': ' || o_orderkey AS ours_msg FROM orders),
b AS (SELECT *, CASE WHEN ours = 'NotRun' OR theirs IN ('Advised', 'NotRun') THEN 'ToolGap' WHEN theirs = 'Clean' THEN CASE ours WHEN 'Clean' THEN 'Agree' ELSE 'Finding' END WHEN ours = 'Clean' THEN 'Miss'
  WHEN theirs = 'Diagnosed' THEN 'BothRefused' WHEN ours = 'Advised' THEN 'Agree' ELSE 'SeverityMismatch' END AS bucket FROM v)"""


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    p, c = F.col("o_orderpriority"), F.col("o_custkey") % 7
    theirs = F.when(p == "1-URGENT", "Clean").when(p == "2-HIGH", "Warned").when(p == "3-MEDIUM", "Diagnosed").when(p == "4-NOT SPECIFIED", "Advised").otherwise("NotRun")
    ours = F.when(c == 0, "NotRun").when(c == 1, "Diagnosed").when(c == 2, "Advised").when(F.col("o_orderstatus") == "F", "Clean").otherwise("Warned")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), theirs.alias("theirs"), ours.alias("ours"), F.concat("o_orderstatus", F.lit(": "), "o_orderkey").alias("ours_msg"))


@query("sweep_bucket", f"WITH {OUTCOME} SELECT bucket, count(*) AS n FROM b GROUP BY bucket")
def _(spark, d):
    return sweep.buckets(_verdicts(spark, d))


@query("sweep_report", f"WITH {OUTCOME}, g AS (SELECT bucket, string_split(ours_msg, ':')[1] AS key, count(*) AS n, min(path) AS example FROM b GROUP BY 1, 2) SELECT bucket, CAST(rank AS INTEGER) AS rank, key, n, example, greatest(groups - 2, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, key) AS rank, count(*) OVER (PARTITION BY bucket) AS groups FROM g) WHERE rank <= 2")
def _(spark, d):
    return sweep.report(_verdicts(spark, d), 2)


@query("parser_coverage", "SELECT count(*) AS files, count(*) FILTER (WHERE o_custkey % 4 >= 1) AS preprocessed, count(*) FILTER (WHERE o_custkey % 4 >= 2) AS parsed, round(100.0 * count(*) FILTER (WHERE o_custkey % 4 >= 2) / count(*) FILTER (WHERE o_custkey % 4 >= 1), 1) AS percent FROM orders")
def _(spark, d):
    return sweep.parser_coverage(table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 4).alias("stage")))


@query("contract_coverage", "WITH n AS (SELECT DISTINCT role AS doc, unnest(regexp_extract_all(lower(text), '([a-z]+tion)', 1)) AS n FROM conversations), t AS (SELECT * FROM n WHERE n < 'm') SELECT n.doc, count(*) AS contracts, count(t.n) AS cited FROM n LEFT JOIN t USING (doc, n) GROUP BY 1")
def _(spark, d):
    docs = table(spark, d, "conversations").select(F.col("role").alias("doc"), "text")
    low = docs.select("doc", F.array_join(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+tion)"), 1), lambda x: x < "m"), " ").alias("text"))
    return sweep.contract_coverage(docs, low, "([a-z]+tion)")


def _units(spark: SparkSession, d: str) -> DataFrame:
    defines, paths = F.array(F.concat(F.lit("D="), F.col("o_orderpriority"))), F.array((F.col("o_custkey") % 5).cast("string"))
    return table(spark, d, "orders").select((F.col("o_custkey") % 400).alias("src"), F.col("o_orderstatus").alias("target_flags"), builds.config_id(defines, paths).alias("config"))


@query("config_distinct", "SELECT count(*) AS units, count(DISTINCT o_orderpriority || '|' || o_custkey % 5) AS configs FROM orders")
def _(spark, d):
    return builds.distinct_configs(_units(spark, d))


@query("unit_fanout", "SELECT o_custkey % 400 AS src, count(*) AS units, count(DISTINCT o_orderpriority || '|' || o_custkey % 5) AS configs FROM orders GROUP BY 1")
def _(spark, d):
    return builds.fanout(_units(spark, d))


@query("flag_sets", "SELECT DISTINCT o_orderstatus AS target_flags FROM orders")
def _(spark, d):
    return builds.flag_sets(_units(spark, d))


@query("envelope_key")
def _(spark, d):
    """One digest; tests compare it over partitionings and row orders."""
    return determinism_key(_queries["select_rank"](spark, d), "select_rank")


# Positions, spans, compact sets ------------------------------------------------------------------------------------------

LINES = "spot AS (SELECT p_size AS tu, p_brand AS file, p_partkey AS line, p_partkey * 16 AS lo, p_partkey * 16 + 1 + p_partkey % 16 AS hi FROM part)"


@query(
    "lookup_loc",
    f"""WITH {LINES}, point AS (SELECT o_orderkey, o_custkey % 50 + 1 AS tu, o_orderkey AS pos FROM orders)
SELECT o_orderkey, file, line, pos - lo + 1 AS "column" FROM point LEFT JOIN spot ON spot.tu = point.tu AND pos >= lo AND pos < hi""",
)
def _(spark, d):
    key = F.col("p_partkey")
    lines = table(spark, d, "part").select(F.col("p_size").alias("tu"), F.col("p_brand").alias("file"), key.alias("line"), (key * 16).alias("lo"), (key * 16 + 1 + key % 16).alias("hi"))
    points = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50 + 1).alias("tu"), F.col("o_orderkey").alias("pos"))
    return intervals.located(points, lines).select("o_orderkey", "file", "line", "column")


@query(
    "tests_for_span",
    f"""WITH {REC}, span AS (SELECT c_custkey AS ask, CASE WHEN c_nationkey < 5 THEN c_custkey - c_custkey % 8 END AS root, c_nationkey, c_custkey FROM customer),
asked AS (SELECT ask, CASE WHEN c_nationkey < 5 THEN p_partkey % 10 ELSE c_custkey % 10 END AS file, CASE WHEN c_nationkey < 5 THEN p_partkey ELSE c_custkey END AS lo,
  CASE WHEN c_nationkey < 5 THEN p_partkey ELSE c_custkey + c_nationkey END AS hi FROM span LEFT JOIN part ON p_partkey = root)
SELECT ask, CASE WHEN bool_or(rec.file IS NOT NULL) THEN {TEXT.format('coalesce(list(DISTINCT test) FILTER (WHERE count > 0), [])')} END AS tests
FROM asked LEFT JOIN rec ON rec.file = asked.file AND rec.line BETWEEN lo AND hi GROUP BY ask""",
)
def _(spark, d):
    key, own = F.col("p_partkey"), F.col("c_custkey")
    expansion = table(spark, d, "part").select(F.lit("t").alias("tu"), key.alias("ctx"), F.when(key % 8 != 0, key - 1).alias("parent"), (key % 10).alias("file"), key.alias("line"))
    spans = table(spark, d, "customer").select(own.alias("ask"), (own % 10).alias("file"), own.alias("lo"), (own + F.col("c_nationkey")).alias("hi"), F.lit("t").alias("tu"), F.when(F.col("c_nationkey") < 5, own).alias("ctx"))
    return coverage.tests_for_spans(sets(spark, d), spans, expansion).select("ask", shown())


@query("variants", f"WITH {REC} SELECT DISTINCT variant FROM rec")
def _(spark, d):
    return coverage.variants(sets(spark, d))


@query("tests", f"WITH {REC} SELECT DISTINCT test FROM rec")
def _(spark, d):
    return coverage.tests_seen(records(spark, d))


@query("compact_sets", f"WITH {REC} SELECT file, line, count(DISTINCT test) AS n_tests FROM rec WHERE count > 0 GROUP BY file, line")
def _(spark, d):
    return coverage.compact_sets(sets(spark, d)).groupBy("file", "line").agg(F.sum(F.bitmap_count("bits")).alias("n_tests"))


@query(
    "compact_union",
    f"""WITH {REC}, asked AS (SELECT p_partkey % 300 AS ask, p_partkey % 10 AS file, p_partkey AS line FROM part)
SELECT ask, count(DISTINCT test) FILTER (WHERE count > 0) AS n_tests FROM asked LEFT JOIN rec ON rec.file = asked.file AND rec.line = asked.line GROUP BY ask""",
)
def _(spark, d):
    asked = table(spark, d, "part").select((F.col("p_partkey") % 300).alias("ask"), (F.col("p_partkey") % 10).alias("file"), F.col("p_partkey").alias("line"))
    return coverage.compact_union(coverage.compact_sets(sets(spark, d)), asked)


@query("select_reasons", f"WITH {CHOICE} SELECT CAST(rank AS INTEGER) AS rank, test, reason, CAST(distance AS INTEGER) AS distance, why FROM ranked JOIN (SELECT test, 'Covers' AS reason, distance, 'Function:' || file || ':' || name AS why FROM cov UNION ALL SELECT test, 'AlwaysRun', NULL, why FROM safe) USING (test)")
def _(spark, d):
    c = _choice(spark, d)
    why = selection.covered_by(c["impacted"], c["lines"], c["tests_of"]).unionByName(selection.safety_set(c["tests"], c["tests_of"], c["suite"]))
    return selection.with_reasons(selection.ranked(selection.selected(why)), why)


@query(
    "condition_diff",
    """WITH a AS (SELECT o_custkey AS tu, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderstatus || ' ' || o_orderpriority AS v FROM orders),
b AS (SELECT o_custkey AS tu, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderstatus || ' ' || o_orderpriority AS v FROM orders WHERE o_totalprice < 300000)
SELECT tu, CAST(pos AS INTEGER) AS pos, a.v AS old, b.v AS new FROM a FULL JOIN b USING (tu, pos) WHERE a.v IS DISTINCT FROM b.v""",
)
def _(spark, d):
    place = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    side = lambda o: o.select(F.col("o_custkey").alias("tu"), (F.row_number().over(place) - 1).alias("ord"), F.col("o_orderstatus").alias("directive"), F.array("o_orderpriority").alias("tokens"))
    orders = table(spark, d, "orders")
    return impact.changed_conditions(side(orders), side(orders.where("o_totalprice < 300000")))


# Graphs --------------------------------------------------------------------------------------------------------------

USES = "uses AS (SELECT DISTINCT s_nationkey AS src, CAST(floor(abs(s_acctbal)) AS BIGINT) % 25 AS dst FROM supplier WHERE s_acctbal > 0)"
#: Blocks of a function (p_size) numbered from 0; a block leads to two later ones, some jump ahead or back.
FLOW = """block AS (SELECT p_size AS func, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS node, p_retailprice > 1200 AS jumps FROM part),
size AS (SELECT func, count(*) AS n FROM block GROUP BY func),
flow AS (SELECT func, node AS src, unnest(CASE WHEN jumps THEN [2 * node + 1, node + 3, node // 2] ELSE [2 * node + 1] END) AS dst FROM block),
edge AS (SELECT DISTINCT flow.func, src, dst FROM flow JOIN size USING (func) WHERE dst < n),
reach(func, node) AS (SELECT func, 0 FROM size UNION SELECT edge.func, dst FROM reach JOIN edge ON edge.func = reach.func AND src = node)"""


def _uses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("src"), (F.floor(F.abs("s_acctbal")).cast("long") % 25).alias("dst"))


def _flow(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    place = Window.partitionBy("p_size").orderBy("p_partkey")
    blocks = table(spark, d, "part").select(F.col("p_size").alias("func"), (F.row_number().over(place) - 1).cast("long").alias("node"), (F.col("p_retailprice") > 1200).alias("jumps"))
    sizes = blocks.groupBy("func").agg(F.count("*").alias("n"))
    x = F.col("node")
    to = F.when(F.col("jumps"), F.array(2 * x + 1, x + 3, F.floor(x / 2))).otherwise(F.array(2 * x + 1))
    edges = blocks.select("func", x.alias("src"), F.explode(to).alias("dst")).join(sizes, "func").where("dst < n").select("func", "src", "dst")
    return blocks, edges, sizes.select("func", F.lit(0).cast("long").alias("node"))


@query("dependency_cycles", f"WITH RECURSIVE {USES}, r(a, b) AS (SELECT src, dst FROM uses UNION SELECT a, dst FROM r JOIN uses ON src = b) SELECT x.a AS node, max(y.a) AS component FROM r x JOIN r y ON x.b = y.a AND y.b = x.a GROUP BY x.a")
def _(spark, d):
    return graphs.cycles(_uses(spark, d))


@query("dependency_layers", f"WITH {USES} SELECT src, dst FROM uses JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey < b.n_regionkey")
def _(spark, d):
    return graphs.layering(_uses(spark, d), table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("layer")))


@query("unreachable_blocks", f"WITH RECURSIVE {FLOW} SELECT func, node FROM block WHERE (func, node) NOT IN (SELECT func, node FROM reach)")
def _(spark, d):
    return graphs.unreachable(*_flow(spark, d))


@query(
    "dominators",
    f"""WITH RECURSIVE {FLOW}, around(func, out, node) AS (SELECT func, node, CAST(0 AS BIGINT) FROM reach WHERE node <> 0 UNION SELECT a.func, a.out, edge.dst FROM around a JOIN edge ON edge.func = a.func AND edge.src = a.node WHERE edge.dst <> a.out),
dom AS (SELECT r.func, r.node, o.node AS dominator FROM reach r JOIN reach o ON o.func = r.func AND o.node <> r.node WHERE (r.func, o.node, r.node) NOT IN (SELECT func, out, node FROM around)),
depth AS (SELECT func, node, count(*) AS depth FROM dom GROUP BY func, node)
SELECT dom.func, CAST(dom.node AS BIGINT) AS node, CAST(dominator AS BIGINT) AS dominator, coalesce(depth, 0) = max(coalesce(depth, 0)) OVER (PARTITION BY dom.func, dom.node) AS immediate FROM dom LEFT JOIN depth ON depth.func = dom.func AND depth.node = dominator""",
)
def _(spark, d):
    _, edges, entries = _flow(spark, d)
    return graphs.dominators(edges, entries)


# Fixed-width integers --------------------------------------------------------------------------------------------------

WIDTHS = (8, 16, 32)
#: x and y of every order; sh shifts beyond the width, too.
WORDS = "word AS (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) * 1000003 - 50000000 + CAST(floor(o_totalprice) AS BIGINT) AS x, CAST(o_custkey % 7 - 3 AS HUGEINT) AS y, o_custkey % 40 AS sh FROM orders)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 1000003 - 50000000 + F.floor("o_totalprice")).cast("long").alias("x"), (F.col("o_custkey") % 7 - 3).cast("long").alias("y"), (F.col("o_custkey") % 40).cast("long").alias("sh"))


def _wrap(x: str, w: int) -> str:
    m = 1 << w
    return f"CAST((({x}) % {m} + {m}) % {m} - CASE WHEN (({x}) % {m} + {m}) % {m} >= {m // 2} THEN {m} ELSE 0 END AS BIGINT)"


def _bits_sql(w: int) -> dict[str, str]:
    u = lambda v: f"(CASE WHEN {v} < 0 THEN {v} + {1 << w} ELSE {v} END)"
    p = "CAST(power(2, sh) AS HUGEINT)"
    return {
        "Add": _wrap("a + y", w), "Sub": _wrap("a - y", w), "Mul": _wrap("a * CAST(a AS HUGEINT)", w),
        "UDiv": f"CASE WHEN y = 0 THEN -1 ELSE {_wrap(f'{u("a")} // {u("y")}', w)} END",
        "SDiv": f"CASE WHEN y = 0 THEN CASE WHEN a < 0 THEN 1 ELSE -1 END ELSE {_wrap('sign(a) * sign(y) * (abs(a) // abs(y))', w)} END",
        "URem": f"CASE WHEN y = 0 THEN a ELSE {_wrap(f'{u("a")} % {u("y")}', w)} END",
        "SRem": "CAST(CASE WHEN y = 0 THEN a ELSE sign(a) * (abs(a) % abs(y)) END AS BIGINT)",
        "And": "a & CAST(y AS BIGINT)", "Or": "a | CAST(y AS BIGINT)", "Xor": "xor(a, CAST(y AS BIGINT))",
        "Shl": f"CASE WHEN sh >= {w} THEN 0 ELSE {_wrap(f'a * {p}', w)} END",
        "LShr": f"CASE WHEN sh >= {w} THEN 0 ELSE {_wrap(f'{u("a")} // {p}', w)} END",
        "AShr": f"CAST(CASE WHEN sh >= {w} THEN CASE WHEN a < 0 THEN -1 ELSE 0 END ELSE (a - (a % {p} + {p}) % {p}) // {p} END AS BIGINT)",
    }


@query("ir_binary", f"WITH {WORDS}" + "".join(f", w{w} AS (SELECT o_orderkey, {w} AS width, {', '.join(f'{e} AS {n.lower()}_' for n, e in _bits_sql(w).items())} FROM (SELECT o_orderkey, {_wrap('x', w)} AS a, y, sh FROM word))" for w in WIDTHS) + " " + " UNION ALL ".join(f"SELECT * FROM w{w}" for w in WIDTHS))
def _(spark, d):
    out, words = None, _words(spark, d)
    for w in WIDTHS:
        a, y, sh = bits.truncated(F.col("x"), w), F.col("y"), F.col("sh")
        other = {"Mul": a, "Shl": sh, "LShr": sh, "AShr": sh}
        rows = words.select("o_orderkey", F.lit(w).alias("width"), *(f(a, other.get(n, y), w).cast("long").alias(f"{n.lower()}_") for n, f in bits.BINARY.items()))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("ir_unary", f"WITH {WORDS} " + " UNION ALL ".join(f"SELECT o_orderkey, {w} AS width, {_wrap('-a', w)} AS neg, -1 - a AS not_ FROM (SELECT o_orderkey, {_wrap('x', w)} AS a FROM word)" for w in WIDTHS))
def _(spark, d):
    a = {w: bits.truncated(F.col("x"), w) for w in WIDTHS}
    each = [_words(spark, d).select("o_orderkey", F.lit(w).alias("width"), bits.UNARY["Neg"](a[w], w).alias("neg"), bits.UNARY["Not"](a[w], w).alias("not_")) for w in WIDTHS]
    return each[0].unionByName(each[1]).unionByName(each[2])


_SIGNS = {"Lt": "<", "Le": "<=", "Gt": ">", "Ge": ">="}


@query("ir_compare", f"WITH {WORDS} " + " UNION ALL ".join(f"SELECT {w} AS width, count(*) FILTER (WHERE a = y) AS eq, count(*) FILTER (WHERE a <> y) AS ne, {', '.join(f'count(*) FILTER (WHERE a {c} y) AS s{n.lower()}, count(*) FILTER (WHERE (a + {1 << w}) % {1 << w} {c} (y + {1 << w}) % {1 << w}) AS u{n.lower()}' for n, c in _SIGNS.items())} FROM (SELECT {_wrap('x', w)} AS a, y FROM word)" for w in WIDTHS))
def _(spark, d):
    out = None
    for w in WIDTHS:
        a, y = bits.truncated(F.col("x"), w), F.col("y")
        rows = _words(spark, d).agg(*(F.count_if(f(a, y, w)).alias(n.lower()) for n, f in bits.COMPARE.items())).select(F.lit(w).alias("width"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("ir_cast", f"WITH {WORDS} SELECT o_orderkey, {_wrap('x', 8)} AS trunc8, {_wrap('x', 16)} AS trunc16, CAST(({_wrap('x', 8)} + 256) % 256 AS BIGINT) AS zext, {_wrap('x', 8)} AS sext, CAST(({_wrap('x', 16)} + 65536) % 65536 AS DOUBLE) AS ui_to_fp, CAST({_wrap('x', 16)} AS DOUBLE) AS si_to_fp FROM word")
def _(spark, d):
    x, cast = F.col("x"), bits.CAST
    low = cast["Trunc"](x, 64, 8)
    return _words(spark, d).select("o_orderkey", low.alias("trunc8"), cast["Trunc"](x, 64, 16).alias("trunc16"), cast["ZExt"](low, 8, 32).alias("zext"), cast["SExt"](low, 8, 32).alias("sext"), cast["UiToFp"](cast["Trunc"](x, 64, 16), 16, 64).alias("ui_to_fp"), cast["SiToFp"](cast["Trunc"](x, 64, 16), 16, 64).alias("si_to_fp"))


@query(
    "ir_builtins",
    f"""WITH {WORDS}, t AS (SELECT o_orderkey, CAST({_wrap('x', 32)} AS HUGEINT) AS a, y, CAST(({_wrap('x', 32)} + 4294967296) % 4294967296 AS BIGINT) AS u FROM word)
SELECT o_orderkey, a + y NOT BETWEEN -2147483648 AND 2147483647 AS add_over, a - y NOT BETWEEN -2147483648 AND 2147483647 AS sub_over, a * a NOT BETWEEN -2147483648 AND 2147483647 AS mul_over,
CAST(CASE WHEN u <> 0 THEN 32 - length(bin(u)) END AS INTEGER) AS clz, CAST(CASE WHEN u <> 0 THEN length(bin(u)) - length(rtrim(bin(u), '0')) END AS INTEGER) AS ctz, CAST(bit_count(u) AS INTEGER) AS popcount,
{_wrap('(u % 256) * 16777216 + (u // 256 % 256) * 65536 + (u // 65536 % 256) * 256 + u // 16777216', 32)} AS bswap FROM t""",
)
def _(spark, d):
    a, y = bits.truncated(F.col("x"), 32), F.col("y")
    return _words(spark, d).select("o_orderkey", bits.overflows("Add", a, y, 32).alias("add_over"), bits.overflows("Sub", a, y, 32).alias("sub_over"), bits.overflows("Mul", a, a, 32).alias("mul_over"), bits.leading_zeros(a, 32).alias("clz"), bits.trailing_zeros(a, 32).alias("ctz"), bits.popcount(a, 32).alias("popcount"), bits.byte_swapped(a, 32).alias("bswap"))


# Constraints -------------------------------------------------------------------------------------------------------


@query(
    "constraint_split",
    """WITH linked AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_orderpriority = '1-URGENT'),
known AS (SELECT o_custkey AS v FROM orders UNION SELECT v + 1 FROM linked),
run AS (SELECT v, sum(CASE WHEN (v - 1) IN (SELECT v FROM linked) THEN 0 ELSE 1 END) OVER (ORDER BY v) AS r FROM known),
comp AS (SELECT v, min(v) OVER (PARTITION BY r) AS component FROM run),
wanted AS (SELECT DISTINCT component FROM comp JOIN customer ON c_custkey = v WHERE c_acctbal < -900)
SELECT o_orderkey AS "constraint", component, component IN (SELECT component FROM wanted) AS relevant FROM orders JOIN comp ON v = o_custkey""",
)
def _(spark, d):
    vars_ = F.when(F.col("o_orderpriority") == "1-URGENT", F.array("o_custkey", F.col("o_custkey") + 1)).otherwise(F.array("o_custkey"))
    mentions = table(spark, d, "orders").select(F.col("o_orderkey").alias("constraint"), F.explode(vars_).alias("var"))
    return constraints.split(mentions, table(spark, d, "customer").where("c_acctbal < -900").select(F.col("c_custkey").alias("var")))


@query(
    "constraint_cache",
    """WITH small AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS item FROM lineitem), n AS (SELECT s, count(*) AS n FROM small GROUP BY s),
big AS (SELECT DISTINCT o_custkey AS b, l_partkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
hit AS (SELECT s, b, count(*) AS k FROM small JOIN big USING (item) GROUP BY s, b)
SELECT s AS "inner", b AS "outer" FROM hit JOIN n USING (s) WHERE k = n""",
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("set"), F.col("l_partkey").alias("item"))
    held = table(spark, d, "orders").select(F.col("o_orderkey").alias("set"), "o_custkey").join(lines, "set").select(F.col("o_custkey").alias("set"), "item")
    return constraints.contained(lines, held)


@query("run_completion", "SELECT o_orderkey AS state, o_orderstatus AS outcome FROM orders ORDER BY 1")
def _(spark, d):
    return findings.completion(table(spark, d, "orders").select(F.col("o_orderkey").alias("state"), F.col("o_orderstatus").alias("outcome")))


@query("string_units", r"""SELECT p_partkey, CAST(octet_length(encode(p_name)) + 2 AS BIGINT) AS n_units, CAST(10 AS BIGINT) AS last FROM part""")
def _(spark, d):
    whole = F.concat(F.lit('"'), F.col("p_name"), F.lit('\\x41\\n"'))
    parts = table(spark, d, "part").select("p_partkey", literals.literal_units(whole).alias("u"))
    return parts.select("p_partkey", F.size("u.units").cast("long").alias("n_units"), F.element_at("u.units", -1).alias("last"))


@query(
    "value_domains",
    """WITH d AS (SELECT l_orderkey, min(l_partkey) % 65536 AS a, max(l_partkey) % 65536 AS b, min(l_suppkey) % 65536 AS c, max(l_suppkey) % 65536 AS e FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, least(a, b) + least(c, e) AS lo, greatest(a, b) + greatest(c, e) AS hi, greatest(least(a, b), least(c, e)) > least(greatest(a, b), greatest(c, e)) AS apart FROM d""",
)
def _(spark, d):
    each = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"), F.min("l_suppkey").alias("c"), F.max("l_suppkey").alias("e"))
    x, y = (domains.between(F.least(F.col(p) % 65536, F.col(q) % 65536), F.greatest(F.col(p) % 65536, F.col(q) % 65536), 32) for p, q in (("a", "b"), ("c", "e")))
    both = domains.BINARY["Add"](x, y, 32)
    return each.select("l_orderkey", both["lo"].alias("lo"), both["hi"].alias("hi"), domains.empty(domains.meet(x, y, 32)).alias("apart"))
