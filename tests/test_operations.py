import io
import json

import pytest
from pyspark.sql import functions as F

from tests.test_operators import EXP, SOURCES, source_facts
from tracewell.envelope import Fidelity
from tracewell.plans import operations, service


@pytest.fixture(scope="module")
def facts(spark):
    after = {**SOURCES, "lib.h": SOURCES["lib.h"].replace("* 2", "* 3", 1)}
    rows = [("lib.c", line, "", test, 1 if line == test + 2 else 0) for line in range(2, 7) for test in range(5)]
    sets = spark.createDataFrame(rows, "file string, line int, variant string, test int, count int")
    from tracewell.operators.coverage import coverage_sets

    e = spark.createDataFrame([("t", 1, None, "LIST", "f.c", 3, 1, 3, 1), ("t", 2, 1, "ITEM", "f.c", 3, 1, 10, 1), ("t", 3, 1, "ITEM", "f.c", 3, 1, 11, 1)], EXP)
    return operations.Facts({"before": source_facts(spark, SOURCES), "after": source_facts(spark, after), "sets": coverage_sets(sets), "test": spark.createDataFrame([(i, True, "Passed") for i in range(5)], "test int, ingested boolean, outcome string"), "expansion": e})


def test_impact_and_selection(facts):
    e = operations.run("impact", facts)
    assert e.fidelity is Fidelity.exact and {r.name for r in e.result.collect()} == {"SCALE", "scaled", "both"}
    e = operations.run("select-tests", facts)
    assert [r.test for r in e.result.collect()] == [0, 2]
    assert e.fidelity is Fidelity.bounded and e.notes["confidence"] == "Full"
    cut = operations.run("select-tests", facts, budget=1)
    assert cut.notes["confidence"] == "Reduced" and cut.fidelity is Fidelity.unknown and cut.result.count() == 1
    assert operations.run("select-tests", facts, budget=2).notes["confidence"] == "Full"


def test_pages_and_chains(facts):
    e = operations.run("expansion-sites", facts, macro="ITEM", limit=1)
    assert (e.notes["total"], e.truncation.shown, e.truncation.cursor, e.fidelity) == (2, 1, 1, Fidelity.bounded)
    assert operations.run("expansion-sites", facts, macro="NONE").proven
    assert operations.run("explain-macro", facts, file="f.c", line=9).fidelity is Fidelity.exact
    assert operations.run("explain-macro", facts, file="g.c", line=3).fidelity is Fidelity.unknown


def test_requests(facts):
    ask = [{"id": 1, "method": "initialize"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "expansion-sites", "arguments": {"macro": "ITEM"}}}, {"id": 4, "method": "tools/call", "params": {"name": "none"}}, {"id": 5, "method": "no"}]
    out = io.StringIO()
    service.serve(facts, io.StringIO("\n".join([*map(json.dumps, ask), "{bad", ""])), out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert {t["name"] for t in said[1]["result"]["tools"]} == set(operations.OPERATIONS)
    assert len(said[2]["result"]["result"]) == 2 and said[2]["result"]["determinism_key"]
    assert [x["error"]["code"] for x in said[3:]] == [-32602, -32601, -32700]


def test_no_row_is_cut_without_a_word(spark):
    rows = [(k, 0, "oob", f"f{k}.c", 3, "o", "f", f"oob: {k}", False, k) for k in range(1_100)]
    f = operations.Facts({"finding": spark.createDataFrame(rows, "id long, state int, kind string, file string, line int, object string, func string, message string, invented_bound boolean, ord long")})
    e = operations.run("find-bugs", f)
    assert e.result.count() == 1_100 and e.truncation is None
    assert len(service.answer(f, "find-bugs", {})["result"]) == 1_100
    assert all(f"oob: {k}" in e.text(rows=None) for k in (0, 555, 1_099))
    assert "20 of 1100 shown" in e.text() and "proven" not in e.text().splitlines()[0]


def test_findings_carry_their_caveats(spark):
    rows = [(1, 0, "oob", "f.c", 3, "o", "f", "oob: x", False, 1), (2, 0, "oob", "f.c", 4, "o", "f", "oob: y", True, 2)]
    f = operations.Facts({"finding": spark.createDataFrame(rows, "id long, state int, kind string, file string, line int, object string, func string, message string, invented_bound boolean, ord long")})
    e = operations.run("find-bugs", f)
    assert e.result.count() == 1 and e.fidelity is Fidelity.bounded and "1 findings" in e.assumptions[0]
    v = operations.Facts({"verdict": spark.createDataFrame([("a", "exact"), ("b", "approximated")], "name string, fidelity string")})
    assert operations.run("prove-equivalent", v).fidelity is Fidelity.approximated
    with pytest.raises(operations.RequestError):
        operations.run("layout", v)
    m = spark.createDataFrame([("s", 0, "a", 0, 1), ("s", 1, "b", 8, 8), ("s", 2, "c", 16, 1)], "tag string, ord int, name string, offset long, size long")
    r = spark.createDataFrame([("s", 24, 8, False, True, True)], "tag string, size long, align long, packed boolean, fields_complete boolean, internal boolean")
    assert operations.run("layout", operations.Facts({"member": m, "record": r})).result.where(F.col("kind") == "PaddingWaste").count() == 1
