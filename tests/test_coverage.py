import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from tracewell.operators import coverage, flow
from tracewell.sources import gcov_json, gcov_native

RECORDS = "test int, variant string, file string, line int, count decimal(20,0)"
ROWS = [(0, "", "x.c", 1, 5), (1, "", "x.c", 1, 0), (0, "", "x.c", 2, 0), (2, "v3", "x.c", 1, 1), (2, "v3", "x.c", 3, 1)]


def by_line(df, value):
    return {r["line"]: r[value] for r in df.collect()}


@pytest.fixture(scope="module")
def sets(spark):
    from decimal import Decimal

    return coverage.coverage_sets(spark.createDataFrame([(*r[:4], Decimal(r[4])) for r in ROWS], RECORDS)).cache()


def test_unknown_zero_and_nonzero_stay_apart(sets):
    counts = by_line(coverage.line_count(sets), "count")
    assert {k: int(v) for k, v in counts.items()} == {1: 6, 2: 0, 3: 1}  # line 4 has no row at all
    assert by_line(coverage.tests_for_lines(sets), "tests") == {1: [0, 2], 2: [], 3: [2]}
    assert by_line(coverage.tests_for_lines_in(sets, ""), "tests") == {1: [0], 2: []}
    assert by_line(coverage.tests_for_lines_in(sets, "v3"), "tests") == {1: [2], 3: [2]}
    assert [r.line for r in coverage.uncovered_lines(sets).collect()] == [2]
    assert [r.line for r in coverage.lines_of(sets, "x.c").collect()] == [1, 2, 3]
    assert coverage.lines_of(sets, "y.c").collect() == []


def test_union_is_null_only_if_all_is_unrecorded(spark, sets):
    asked = spark.createDataFrame([("a", "x.c", 2), ("a", "x.c", 4), ("b", "x.c", 4), ("c", "x.c", 1), ("c", "x.c", 3)], "ask string, file string, line int")
    assert {r.ask: r.tests for r in coverage.tests_for_asked(sets, asked).collect()} == {"a": [], "b": None, "c": [0, 2]}
    spans = spark.createDataFrame([("all", "x.c", 1, 200), ("none", "x.c", 4, 9), ("two", "x.c", 2, 2)], "ask string, file string, lo int, hi int")
    assert {r.ask: r.tests for r in coverage.tests_for_ranges(sets, spans).collect()} == {"all": [0, 2], "none": None, "two": []}


def test_sums_saturate_and_of_nothing_are_null(spark):
    from decimal import Decimal

    top = Decimal((1 << 64) - 1)
    df = spark.createDataFrame([("f", 1, "", 0, top), ("f", 1, "", 1, Decimal(7)), ("f", 2, "", 0, None)], "file string, line int, variant string, test int, count decimal(20,0)")
    counts = by_line(coverage.line_count(coverage.coverage_sets(df)), "count")
    assert counts == {1: top, 2: None}


def test_outcomes_and_validity(spark):
    rows = [(0, True, "Passed"), (1, True, "Failed"), (2, False, "Passed"), (3, True, "Crashed"), (4, False, "TimedOut"), (5, True, None)]
    tests = spark.createDataFrame(rows, "test int, ingested boolean, outcome string")
    assert [r.c for r in tests.select(coverage.coverage_complete().alias("c"), "test").orderBy("test").collect()] == [True, True, False, False, False, False]
    assert [r.test for r in coverage.always_run(tests).collect()] == [2, 3, 4]
    then = spark.createDataFrame([("a.c", "1"), ("b.c", "2")], "file string, hash string")
    state = lambda now: tuple(coverage.validity(then, now, tests).first())
    assert state(then) == ("Partial", [], [2, 3, 4])
    assert state(then.where("file = 'a.c'"))[:2] == ("Stale", ["b.c"])  # deletion is a change, and outranks Partial
    assert coverage.validity(then, then, tests.where("test < 2")).first().state == "Fresh"


REPORT = {"format_version": "2", "gcc_version": "13.3.0", "files": [{"file": "t.c", "functions": [], "lines": [{"line_number": 3, "count": 1}]}, {"file": "m.h", "functions": [], "lines": [{"line_number": 2, "count": 1}, {"line_number": 5, "count": 0}]}]}


def write(path, doc):
    with gzip.open(path, "wt") as f:
        f.write(doc if isinstance(doc, str) else json.dumps(doc))
    return str(path)


def test_json_reports(spark, tmp_path):
    p = write(tmp_path / gcov_json.report_name("t"), REPORT)
    lines = gcov_json.read_lines(spark, p)
    index = coverage.coverage_sets(lines)
    assert by_line(coverage.line_count(index).where("file = 'm.h'"), "count") == {2: 1, 5: 0}  # m.h:1, a macro body, has no record
    assert by_line(coverage.tests_for_lines(index).where("file = 't.c'"), "tests") == {3: None}  # nobody was attributed
    tests = spark.createDataFrame([("t.gcov.json.gz", 0)], "artifact string, test int")
    index = coverage.coverage_sets(gcov_json.read_lines(spark, p, tests))
    assert by_line(coverage.tests_for_lines(index).where("file = 'm.h'"), "tests") == {2: [0], 5: []}
    both = coverage.coverage_sets(lines.unionByName(lines))
    assert by_line(coverage.line_count(both).where("file = 't.c'"), "count") == {3: 2}


@pytest.mark.parametrize("doc", ["{not json", {"format_version": "2"}, {"files": [{"file": "a.c", "lines": [{"line_number": 1}]}]}])
def test_a_broken_report_is_an_error_and_leaves_no_trace(spark, tmp_path, doc):
    p = write(tmp_path / "bad.gcov.json.gz", doc)
    with pytest.raises(Exception, match="not JSON|no files|without number"):
        gcov_json.read_lines(spark, p).collect()
    reports = gcov_json.read_reports(spark, [p, write(tmp_path / "ok.gcov.json.gz", REPORT)])
    tests = spark.createDataFrame([("bad.gcov.json.gz", 1), ("ok.gcov.json.gz", 2)], "artifact string, test int")
    assert {r.test for r in gcov_json.line_records(reports, tests, strict=False).collect()} == {2}
    assert gcov_json.refused(reports).count() == 1


def test_a_missing_report_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|no report"):
        gcov_json.read_lines(spark, str(tmp_path / "t.c.gcov.json.gz"))


# Flow ---------------------------------------------------------------------------------------------------------------

GRAPH = [(0, 1, 1), (1, 2, 0), (1, 3, 1), (2, 3, 1), (3, 0, 0)]


def test_flow_is_solved_by_conservation():
    count = flow.solve(GRAPH, [3, 5], 4)
    assert count == [5, 3, 2, 3, 5]
    assert flow.block_totals(GRAPH, count, 4) == [5, 5, 3, 5]
    assert flow.solve(GRAPH, [0, 0], 4) == [0] * 5
    assert flow.solve(GRAPH, [9, 5], 4) is None
    for wrong in ([3], [3, 5, 1]):
        with pytest.raises(flow.FlowError):
            flow.solve(GRAPH, wrong, 4)


def test_cycles_take_their_least_count_once():
    arcs = [(0, 1, 0), (1, 2, 0), (2, 1, 0), (1, 3, 0), (2, 3, 0)]
    assert flow.cycle_count(arcs, [1, 5, 4, 1, 0], [1, 2]) == 4
    assert flow.cycle_count(arcs, [1, 5, 0, 1, 5], [1, 2]) == 0
    assert flow.cycle_count([(1, 1, 0)], [7], [1]) == 7
    two = [(1, 2, 0), (2, 1, 0), (2, 3, 0), (3, 1, 0)]
    assert flow.cycle_count(two, [5, 2, 3, 3], [1, 2, 3]) == 5


def test_a_loop_on_one_line_counts_iterations():
    # entry 0 -> 2; loop header 2 -> body 3 -> 2; 2 -> exit: one line holds it all.
    arcs = [(0, 2, 0), (2, 3, 0), (3, 2, 0), (2, 4, 0), (4, 1, 0)]
    _, graphed = flow.line_counts(arcs, [1, 4, 4, 1, 1], 5, [(2, "loop.c", [1]), (3, "loop.c", [1])])
    assert graphed == {("loop.c", 1): 5}


def test_solved_names_the_unsolved(spark):
    from decimal import Decimal

    arcs = spark.createDataFrame([(f, i, *a) for f in ("ok", "bad") for i, a in enumerate(GRAPH)], "func string, arc_ix int, src int, dst int, flags int")
    counters = spark.createDataFrame([("ok", 0, Decimal(3)), ("ok", 1, Decimal(5)), ("bad", 0, Decimal(9)), ("bad", 1, Decimal(5))], "func string, ix int, value decimal(20,0)")
    rows = {(r.func, r.arc_ix): r["count"] for r in flow.solved(arcs, counters).collect()}
    assert rows == {("bad", -1): None} | {("ok", i): c for i, c in enumerate([5, 3, 2, 3, 5])}


@pytest.mark.parametrize(("parts", "want"), [([("graphed", 2), ("accumulated", 7)], 2), ([("graphed", 2), ("graphed", 3)], 5), ([("accumulated", 4), ("accumulated", 7)], 11), ([("graphed", 2), ("private", 3)], 5)])
def test_merging_within_an_object(spark, parts, want):
    from decimal import Decimal

    df = spark.createDataFrame([("o", "h.h", 10, k, Decimal(c)) for k, c in parts], "object string, file string, line int, kind string, count decimal(20,0)")
    assert coverage.merged_in_object(df).first()["count"] == want
    two = df.unionByName(df.withColumn("object", F.lit("p")))
    assert coverage.merged_over_objects(coverage.merged_in_object(two)).first()["count"] == 2 * want


def test_arcs_and_blocks(spark):
    from decimal import Decimal

    rows = [("f", i, s, d, fl, 0, Decimal(c)) for i, ((s, d, fl), c) in enumerate(zip([*GRAPH, (2, 0, 2)], [5, 3, 2, 3, 5, 9], strict=True))]
    arcs = coverage.real_arcs(spark.createDataFrame(rows, "func string, arc_ix int, src int, dst int, flags int, test int, count decimal(20,0)"))
    assert [r.arc_ix for r in arcs.collect()] == [0, 1, 2, 3, 4]
    assert {r.block: int(r["count"]) for r in coverage.block_counts(arcs).collect()} == {0: 5, 1: 5, 2: 3, 3: 5}
    zero = arcs.withColumn("count", F.when(F.col("arc_ix") == 1, 0).otherwise(F.col("count")).cast("decimal(20,0)"))
    entered = coverage.entered_blocks(zero)
    assert {r.block: r.entered for r in entered.collect()}[2] is False
    lines = spark.createDataFrame([("f", 2, "a.c", 7), ("f", 3, "a.c", 7), ("f", 2, "a.c", 8), ("f", 9, "a.c", 9)], "func string, block int, file string, line int")
    assert by_line(coverage.lines_reached(entered, lines), "reached") == {7: True, 8: False}


# Native artifacts, written by an encoder of our own --------------------------------------------------------------------


def text(s, in_bytes):
    raw = s.encode() + b"\0"
    if in_bytes:
        return struct.pack("<I", len(raw)) + raw
    raw += b"\0" * (-len(raw) % 4)
    return struct.pack("<I", len(raw) // 4) + raw


def record(tag, payload, in_bytes, size=None):
    n = len(payload) if size is None else size
    return struct.pack("<Ii", tag, n if in_bytes else n // 4) + payload


def artifact(kind, body, in_bytes, stamp=7):
    version = struct.unpack(">I", b"B33*" if in_bytes else b"408*")[0]
    head = struct.pack("<III", kind, version, stamp)
    if in_bytes:
        head += struct.pack("<I", 1)
        if kind == gcov_native.NOTES:
            head += text("/w", True) + struct.pack("<I", 1)
    return head + body


def pair(in_bytes, counters, name="f", elide=False, stamp=7):
    extra = struct.pack("<I", 0) if in_bytes else b""
    ends = struct.pack("<III", 1, 9, 1) if in_bytes else b""
    func = struct.pack("<III", 11, 22, 33) + text(name, in_bytes) + extra + text("./a.c", in_bytes) + struct.pack("<I", 1) + ends
    blocks = struct.pack("<I", 4) if in_bytes else b"\0" * 16
    body = record(gcov_native.FUNCTION, func, in_bytes) + record(gcov_native.BLOCKS, blocks, in_bytes)
    for src in range(4):
        out = [a for a in GRAPH if a[0] == src]
        body += record(gcov_native.ARCS, struct.pack("<I", src) + b"".join(struct.pack("<II", d, fl) for _, d, fl in out), in_bytes)
    lines = struct.pack("<II", 1, 0) + text("a.c", in_bytes) + struct.pack("<III", 2, 3, 0) + text("b.h", in_bytes) + struct.pack("<II", 8, 0) + struct.pack("<I", 0)
    body += record(gcov_native.LINES, lines, in_bytes)
    data = record(gcov_native.FUNCTION, struct.pack("<III", 11, 22, 33), in_bytes)
    raw = b"".join(struct.pack("<Q", c) for c in counters)
    data += record(gcov_native.COUNTERS, b"" if elide else raw, in_bytes, -len(raw) if elide else None)
    return artifact(gcov_native.NOTES, body, in_bytes), artifact(gcov_native.DATA, data + b"\0" * 4, in_bytes, stamp)


@pytest.mark.parametrize("in_bytes", [True, False])
def test_native_artifacts(spark, tmp_path, in_bytes):
    for stem, args in {"run": dict(counters=[3, 5]), "idle": dict(counters=[0, 0], elide=True), "bad": dict(counters=[9, 5]), "short": dict(counters=[3]), "other": dict(counters=[3, 5], stamp=8)}.items():
        notes, data = pair(in_bytes, **args)
        (tmp_path / f"{stem}.gcno").write_bytes(notes)
        (tmp_path / f"{stem}.gcda").write_bytes(data if stem != "cut" else data[:-9])
    rows = gcov_native.decoded(gcov_native.read_pairs(spark, str(tmp_path / "*.gcno"), str(tmp_path / "*.gcda"))).cache()
    last = lambda p: p.rsplit("/", 1)[1]
    assert {last(r.object) for r in gcov_native.refused(rows).collect()} == {"short", "other"}
    assert [(last(r.object), r.func) for r in gcov_native.unsolved(rows).collect()] == [("bad", "f")]
    merged = {(last(r.object), r.file, r.line): int(r["count"]) for r in coverage.merged_in_object(gcov_native.line_parts(rows)).collect()}
    assert merged == {("run", "a.c", 2): 5, ("run", "a.c", 3): 5, ("run", "b.h", 8): 5, ("idle", "a.c", 2): 0, ("idle", "a.c", 3): 0, ("idle", "b.h", 8): 0}
    arcs = gcov_native.arc_rows(rows).where("object like '%run'").orderBy("arc_ix").collect()
    assert [int(r["count"]) for r in arcs] == [5, 3, 2, 3, 5] and arcs[0].func.file == "a.c"


def test_version_tags():
    h = lambda tag: gcov_native.Header(gcov_native.NOTES, struct.unpack(">I", tag)[0], 0)
    assert h(b"B33*").release == (13, 3) and h(b"B33*").in_bytes
    assert h(b"408*").release == (4, 8) and not h(b"408*").in_bytes
    assert h(b"ZZZZ").release is None
    with pytest.raises(gcov_native.ArtifactError):
        gcov_native.header(b"junkjunkjunk")
