import random

import pytest
from pyspark.sql import functions as F

from tracewell.envelope import Envelope, Fidelity
from tracewell.functions import bits, domains, facts, literals, paths
from tracewell.operators import builds, constraints, findings, fixpoint, graphs, impact, intervals, layout, recipes, selection, sites, sweep
from tracewell.sources import compdb, csource, files, persona
from tracewell.streaming import ingest


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Fixpoints ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("calls", "root", "depth", "order", "beyond"),
    [
        ([("root", "d1"), ("d1", "d2"), ("d2", "d3")], "root", 1, ["root", "d1"], 1),
        ([("root", "d1"), ("d1", "d2"), ("d2", "d3")], "root", 3, ["root", "d1", "d2", "d3"], 0),
        ([("root", "a"), ("root", "b"), ("a", "s"), ("b", "s")], "root", 1, ["root", "a", "b"], 1),
        ([("a", "b"), ("b", "a"), ("b", "c")], "a", 10, ["a", "b", "c"], 0),
        ([("r", "z"), ("r", "a"), ("a", "m"), ("z", "n")], "r", 2, ["r", "z", "a", "n", "m"], 0),
    ],
)
def test_bounded_closure_in_order(spark, calls, root, depth, order, beyond):
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(calls)], "src string, dst string, ord int")
    placed, out = fixpoint.reached_in_order(spark.createDataFrame([(root, 0)], "node string, ord int"), edges, depth)
    assert [r.node for r in placed.orderBy("depth", "path").collect()] == order
    assert out.count() == beyond


def test_roots_ancestors_and_components(spark):
    tree = spark.createDataFrame([(0, None), *((i, (i - 1) // 2) for i in range(1, 40)), (100, 101), (101, 100)], "node int, parent int")
    got = {r.node: (r.root, r.depth) for r in fixpoint.roots(tree).collect()}
    depth = lambda i: 0 if not i else 1 + depth((i - 1) // 2)
    assert got == {i: (0, depth(i)) for i in range(40)}
    up = {(r.node, r.ancestor): r.depth for r in fixpoint.ancestors(tree).collect()}
    assert up[38, 0] == depth(38) and (100, 101) in up and sum(n == 38 for n, _ in up) == depth(38)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i % 10 != 9], "a int, b int")
    assert {r.node: r.component for r in fixpoint.connected(edges).collect()} == {i: i // 10 * 10 for i in range(30)}


# Impact and selection --------------------------------------------------------------------------------------------------

FP = "kind string, file string, name string, head array<string>, tail array<string>"


def fp(kind, name, head=("int",), tail=("{", "}"), file="a.c"):
    return (kind, file, name, list(head), list(tail))


def test_classes(spark):
    old = [fp("Function", "same"), fp("Function", "body"), fp("Function", "sig"), fp("Function", "gone"), fp("Global", "g", tail=("=", "1")), fp("Macro", "M", ("M", "(", "v", ")"), ("v",)), fp("Macro", "N", ("N",), ("1",))]
    new = [fp("Function", "same"), fp("Function", "body", tail=("{", "x", "}")), fp("Function", "sig", ("long",)), fp("Function", "new"), fp("Global", "g", tail=("=", "2")), fp("Macro", "M", ("M", "(", "v", ")"), ("v", "v")), fp("Macro", "N", ("N", "(", ")"), ("1",))]
    found = impact.classified(impact.entity_diff(spark.createDataFrame(old, FP), spark.createDataFrame(new, FP)))
    assert {r.name: r["class"] for r in found.collect()} == {"body": "BodyChanged", "sig": "SignatureChanged", "gone": "Removed", "new": "Added", "g": "InitializerChanged", "M": "MacroBodyChanged", "N": "MacroInterfaceChanged"}


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        ((8, [("a", 0), ("b", 4), ("c", 6)]), (8, [("a", 0), ("c", 4), ("b", 6)]), ("LayoutChanged", 0)),
        ((8, [("v", 0), ("len", 4)]), (5, [("v", 0), ("len", 1)]), ("LayoutChanged", -3)),
        ((8, [("a", 0), ("b", 4)]), (8, [("a", 0), ("renamed", 4)]), ("BodyChanged", None)),
    ],
)
def test_record_classes(spark, old, new, want):
    shape = lambda x: spark.createDataFrame([("s", x[0], 4, False)], "tag string, size long, align long, is_union boolean")
    field = lambda x: spark.createDataFrame([("s", n, o, None, None) for n, o in x[1]], "tag string, name string, offset long, bit_offset long, bit_width long")
    diff = impact.entity_diff(*(spark.createDataFrame([fp("Record", "s", ("struct", "s"), [n for n, _ in x[1]] + [str(x)])], FP) for x in (old, new)))
    r = impact.classified(diff, impact.record_changes(shape(old), shape(new), field(old), field(new))).first()
    assert (r["class"], r["size_delta"]) == want


EDGES = "kind string, file string, name string, mentioned string, ord long"


def closure(spark, changed, edges, **more):
    first = spark.createDataFrame([("Function", "a.c", n, "BodyChanged", None) for n in changed], "kind string, file string, name string, class string, size_delta long")
    df = spark.createDataFrame([("Function", "a.c", h, m, i) for i, (h, m) in enumerate(edges)], EDGES)
    return {r.name: (r.distance, r["class"], r.root.name, r.path) for r in impact.impact(first, df, **more).collect()}


def test_closure(spark):
    got = closure(spark, ["leaf"], [("mid", "leaf"), ("top", "mid"), ("other", "else")])
    assert got == {"leaf": (0, "BodyChanged", "leaf", ["DirectlyChanged"]), "mid": (1, "BodyChanged", "leaf", ["Calls"]), "top": (2, "BodyChanged", "leaf", ["Calls", "Calls"])}
    assert {k: v[0] for k, v in closure(spark, ["a"], [("a", "b"), ("b", "a")]).items()} == {"a": 0, "b": 1}
    # Two members are mentioned: the first in frontier order gives the root.
    assert closure(spark, ["m1", "m2"], [("h", "m2"), ("h", "m1")])["h"][2] == "m1"


def test_widening(spark):
    ents = spark.createDataFrame([("Function", "a.c", "x"), ("Function", "b.c", "y"), ("Global", "b.c", "z")], "kind string, file string, name string")
    got = closure(spark, ["x"], [], entities=ents, unclean=spark.createDataFrame([("b.c",)], "file string"))
    assert {k: v[1] for k, v in got.items()} == {"x": "BodyChanged", "y": "Unknown", "z": "Unknown"}
    got = closure(spark, ["x"], [], entities=ents, conditions_changed=True)
    assert {k: v[1] for k, v in got.items()} == {"x": "BodyChanged", "y": "ConfigChanged", "z": "ConfigChanged"}
    assert impact.Completeness().complete and not impact.Completeness(unparsed_files=("b.c",)).complete


def test_indirect_calls_need_a_fitting_arity(spark):
    changed = spark.createDataFrame([("Function", "a.c", "cb"), ("Function", "a.c", "log")], "kind string, file string, name string")
    arity = spark.createDataFrame([("cb", 1, False), ("log", 1, True)], "name string, params int, variadic boolean")
    calls = spark.createDataFrame([("Function", "a.c", f"h{n}", n) for n in range(4)], "kind string, file string, name string, args int")
    taken = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert rows(impact.indirect_holders(changed, calls, arity, taken("cb")).select("name", "callee", "distance")) == [("h1", "cb", 1)]
    assert [r.name for r in impact.indirect_holders(changed, calls, arity, taken("log")).orderBy("name").collect()] == ["h1", "h2", "h3"]
    again = closure(spark, ["cb"], [("far", "h1")], indirect=impact.indirect_holders(changed, calls, arity, taken("cb")))
    assert again["h1"][0] == 1 and again["h1"][3] == ["IndirectCall"] and again["far"][0] == 2


def test_indirect_calls_are_settled_by_arity_not_by_pair(spark):
    """Brute force over odd rows; and every join gives as many rows as there are sites at most, whatever fits."""
    some = [("Function", f"f{k % 3}.c", f"n{k % 37:02d}", k % 4) for k in range(60)] + [("Macro", "f.c", "n38", 0), ("Function", "f.c", None, 0)]
    arities = [(f"n{k % 40:02d}", k % 5 if k % 11 else None, k % 7 == 0) for k in range(80)]
    names = [f"n{k:02d}" for k in range(40) if k % 9] * 2
    holders = [("Function", f"g{k % 2}.c", f"h{k % 50}", k % 8 if k % 13 else None) for k in range(200)]
    changed = spark.createDataFrame(some, "kind string, file string, name string, distance int")
    arity = spark.createDataFrame(arities, "name string, params int, variadic boolean")
    sites = spark.createDataFrame(holders, "kind string, file string, name string, args int")
    found = impact.indirect_holders(changed, sites, arity, spark.createDataFrame([(x,) for x in names], "name string"))
    want = {}
    for kind, file, name, args in holders:
        fits = [(d, n) for k, _, n, d in some if k == "Function" and n in names for a, params, more in arities if a == n and None not in (args, params) and (args == params and not more or more and args >= params)]
        if fits:
            want[kind, file, name] = min([*fits, *([want[kind, file, name]] if (kind, file, name) in want else [])])
    assert {(r.kind, r.file, r.name): (r.distance - 1, r.callee) for r in found.collect()} == want
    many = spark.range(3000).select(F.lit("Function").alias("kind"), F.lit("f.c").alias("file"), F.format_string("m%04d", "id").alias("name"))
    wide = spark.range(500).select(F.lit("Function").alias("kind"), F.lit("g.c").alias("file"), F.col("id").alias("name"), (F.col("id") % 3).cast("int").alias("args"))
    found = impact.indirect_holders(many, wide, many.select("name", F.lit(1).alias("params"), (F.length("name") > 9).alias("variadic")), many.select("name"))
    assert {(r.name % 3, r.callee) for r in found.collect()} == {(1, "m0000")}
    plan, todo, made = found._jdf.queryExecution().executedPlan(), [], []
    todo.append(plan)
    while todo:
        x = todo.pop()
        kind = x.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(x.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(x.plan())
        else:
            if "Join" in kind and x.metrics().contains("numOutputRows"):
                made.append(x.metrics().apply("numOutputRows").value())
            todo += [x.children().apply(k) for k in range(x.children().size())]
    assert made and max(made) <= 3000


def test_conditions_by_position_of_their_unit(spark):
    old = spark.createDataFrame([("a", 0, "if", ["A"]), ("a", 1, "if", ["B"]), ("b", 0, "if", ["B"])], "tu string, ord int, directive string, tokens array<string>")
    assert impact.changed_conditions(old, old).count() == 0
    assert [(r.tu, r.pos) for r in impact.changed_conditions(old, old.where("tu = 'b' or ord = 0")).collect()] == [("a", 1)]


SOURCES = {"lib.h": "#define SCALE(v) ((v) * 2)\n#define OFFSET(v) ((v) + 1)\n", "lib.c": '#include "lib.h"\nint scaled(int x) { return SCALE(x); }\nint offset(int x) { return OFFSET(x); }\nint both(int x) { return SCALE(OFFSET(x)); }\nint untouched(int x) { return x - 1; }\nint gate(int x) { return x > 0; }\n'}
MUTATIONS = [("lib.h", "* 2", "* 3", {0, 2}), ("lib.h", "* 2", "* 0", {0, 2}), ("lib.h", "((v) * 2)", "((v) + 1)", {0, 2}), ("lib.h", "+ 1", "+ 2", {1, 2}), ("lib.h", "+ 1", "- 1", {1, 2}), ("lib.h", "((v) + 1)", "((v) * 2)", {1, 2}), ("lib.c", "x - 1", "x - 2", {3}), ("lib.c", "x > 0", "x >= 0", {4})]


def source_facts(spark, sources):
    units = spark.createDataFrame([("lib.c", sources["lib.c"])], "tu string, text string")
    return csource.unit_facts(units, spark.createDataFrame([("lib.h", sources["lib.h"])], "path string, text string")).cache()


def test_selection_under_mutation(spark):
    """A header macro changed: which tests run? All that fail, and not the others."""
    tests_of = spark.createDataFrame([("lib.c", i + 2, [i]) for i in range(5)], "file string, line int, tests array<int>")
    tests = spark.createDataFrame([(i, True, "Passed") for i in range(5)], "test int, ingested boolean, outcome string")
    before = source_facts(spark, SOURCES)
    need, got, base = [], [], []
    for k, (file, a, b, fails) in enumerate(MUTATIONS):
        after = source_facts(spark, {**SOURCES, file: SOURCES[file].replace(a, b, 1)})
        changed = impact.classified(impact.entity_diff(csource.fingerprints(before), csource.fingerprints(after)))
        edges = csource.edges(before).unionByName(csource.edges(after, 10_000_000))
        found = impact.impact(changed, edges)
        lines = csource.entity_lines(after)
        reasons = selection.covered_by(found, lines, tests_of).unionByName(selection.safety_set(tests, tests_of))
        chosen = {r.test for r in selection.selected(reasons).collect()}
        need += [(k, t) for t in fails]
        got += [(k, t) for t in chosen]
        where = [(k, file, 1 + SOURCES[file][: SOURCES[file].index(a)].count("\n"))]
        base += [tuple(r) for r in selection.baseline(spark.createDataFrame(where, "mutation int, file string, line int"), tests_of).collect()]
        if file == "lib.h":
            assert not chosen & {3, 4}
    pairs = lambda x: spark.createDataFrame(x, "mutation int, test int")
    r = selection.recall(pairs(need), pairs(got), 5).first()
    assert (r.required, r.hit, r.n_selected, round(r.reduction, 3)) == (14, 14, 14, 0.65)
    assert selection.recall(pairs(need), pairs(base), 5).first().hit == 2


def test_refinement_budget_and_safety(spark):
    ent = spark.createDataFrame([("Function", "a.c", "f", 0), ("Function", "a.c", "g", 0)], "kind string, file string, name string, distance int")
    lines = ent.select("kind", "file", "name", F.when(F.col("name") == "f", 1).otherwise(2).alias("line"))
    tests_of = spark.createDataFrame([("a.c", 1, [0]), ("a.c", 2, [1])], "file string, line int, tests array<int>")
    for fidelity, left in (("exact", ["f"]), ("bounded", ["f", "g"]), ("unknown", ["f", "g"])):
        v = spark.createDataFrame([("Function", "a.c", "g", "Equivalent", fidelity)], "kind string, file string, name string, verdict string, fidelity string")
        kept, proven = selection.refined(ent, v)
        assert sorted(r.name for r in kept.collect()) == left
        if fidelity == "exact":
            chosen = selection.selected(selection.covered_by(kept, lines, tests_of))
            assert rows(selection.excluded(proven, lines, tests_of, chosen)) == [(1, "Function:a.c:g")]
    tests = spark.createDataFrame([(0, True, "Passed"), (1, True, "Passed"), (2, True, "Crashed"), (3, True, "Passed")], "test int, ingested boolean, outcome string")
    suite = spark.createDataFrame([(0,), (9,)], "test int")
    safe = {r.test: r.why for r in selection.safety_set(tests.where("test < 3"), tests_of, suite).where("why <> 'no line attributed'").collect()}
    assert safe == {2: "no complete coverage", 9: "never measured"}
    assert {r.test for r in selection.safety_set(tests, tests_of).where("why = 'no line attributed'").collect()} == {2, 3}
    assert selection.safety_set(tests, tests_of, complete=False).where("why = 'impact is incomplete'").count() == 4
    order = selection.ranked(selection.selected(selection.covered_by(ent, lines, tests_of)))
    assert rows(order.select("test", "rank")) == [(0, 1), (1, 2)]
    assert tuple(selection.budget_effect(order, 2).first()) == (2, 0, "Full")
    assert tuple(selection.budget_effect(order, 1).first()) == (1, 1, "Reduced")
    assert selection.confidence(impact.Completeness()).full and not selection.confidence(impact.Completeness(), dropped=1).full
    odd = spark.createDataFrame([("Function", "z.c", "u", 0), ("Function", "a.c", "w", 0), ("Function", "a.c", "n", 0)], "kind string, file string, name string, distance int")
    where = spark.createDataFrame([("Function", "z.c", "u", 1), ("Function", "a.c", "w", 99)], "kind string, file string, name string, line int")
    assert {r.name: r.why for r in selection.unmatched(odd, where, tests_of).collect()} == {"u": "file not in index", "w": "no coverage", "n": "no line"}


def test_recall_of_nothing_is_null(spark):
    none = spark.createDataFrame([], "mutation int, test int")
    assert selection.recall(none, none, 5).first().recall is None


# Sites, recipes, layout, findings, sweeps ---------------------------------------------------------------------------------

EXP = "tu string, ctx int, parent int, macro string, file string, line int, col int, item_line int, item_col int"


def test_sites_and_chains(spark):
    e = spark.createDataFrame([("t", 1, None, "LIST", "f.c", 3, 1, 3, 1), ("t", 2, 1, "ITEM", "f.c", 3, 1, 10, 1), ("t", 3, 1, "ITEM", "f.c", 3, 1, 11, 1), ("t", 4, 1, "ITEM", "f.c", 3, 1, 10, 1)], EXP)
    found = sites.distinct_sites(e, "ITEM")
    assert found.count() == 2
    seen, at = [], 0
    while at is not None:
        seen += [r.item_line for r in sites.paged(found, sites.PLACE, at, 1).collect()]
        at = sites.page_end(2, at, 1)
    assert seen == [10, 11]
    assert sites.paged(found, sites.PLACE, 9, 1).count() == 0 and sites.page_end(2, 9, 1) is None
    got = sites.explained(e, "f.c", 3).collect()
    assert [(r.ctx, r.chain) for r in got] == [(2, ["ITEM", "LIST"]), (4, ["ITEM", "LIST"]), (3, ["ITEM", "LIST"])]
    assert sites.explained(e, "f.c", 9).count() == 0


def test_recipes(spark):
    f = spark.createDataFrame([("show_command_fn", "src/vnet/a_cli.c"), ("x_cli", "src/b.c"), ("helper", "src/vnet/sub/c_cli.c")], "name string, file string")
    cases = [([], 3, 0), ([("name matches", "_command_fn$|_cli$")], 2, 0), ([("in_file", "src/vnet/**/*_cli.c")], 2, 0), ([("in_file", "src/*.c")], 1, 0), ([("registered_via", "X")], 0, 3)]
    got = recipes.tally(f, [(str(i), s) for i, (s, _, _) in enumerate(cases)]).collect()
    assert [(r.matched, r.needs_ast) for r in got] == [(m, n) for _, m, n in cases]
    text = 'recipe r\nscope name matches "_cli$"\nfixture good "g.c"\nfixture bad "b.c" at "3"\nwhy: because\n'
    r = recipes.parse_recipe(text)
    assert (r.name, r.scope, r.text) == ("r", [("name matches", "_cli$")], {"why": "because"})
    for cut in ('fixture good "g.c"\n', 'fixture bad "b.c" at "3"\n'):
        with pytest.raises(recipes.RecipeError):
            recipes.parse_recipe(text.replace(cut, ""))
    for bad in ('fixture bad "b.c"', "scope colour red", 'scope name matches "("'):
        with pytest.raises(recipes.RecipeError):
            recipes.parse_recipe(text + bad + "\n")


def test_layout(spark):
    m = spark.createDataFrame([("s", 0, "c0", 0, 1), ("s", 1, "l", 8, 8), ("s", 2, "c1", 16, 1), ("u", 0, "x", 60, 8), ("w", 0, "big", 0, 128), ("h", 0, "a", 0, 8), ("h", 1, "b", 72, 8)], "tag string, ord int, name string, offset long, size long")
    r = spark.createDataFrame([("s", 24, 8, False, True, True), ("u", 72, 4, False, True, False), ("w", 128, 8, False, True, True), ("h", 80, 8, False, True, True)], "tag string, size long, align long, packed boolean, fields_complete boolean, internal boolean")
    assert rows(layout.padding(m.where("tag = 's'"), r)) == [("s", 24, 16, 8)]
    assert layout.padding(m.where("tag = 's'"), r.withColumn("packed", F.lit(True))).count() == 0
    assert layout.padding(m.where("tag = 's'"), r.withColumn("fields_complete", F.lit(False))).count() == 0
    assert sorted((x.after, x.before, x.bytes) for x in layout.holes(m.where("tag = 's'"), r.where("tag = 's'")).collect()) == [("c0", "l", 7), ("c1", None, 7)]
    assert rows(layout.straddles(m)) == [("u", "x", 64)]
    acc = spark.createDataFrame([("h", "a", 5), ("h", "b", 9)], "tag string, name string, accesses long")
    assert rows(layout.hot_fields(m, acc)) == [("h", "b", 9)]
    p = {(x.tag, x.kind): (x.benefit, x.advisory) for x in layout.proposals(m, r, acc).collect()}
    assert p["s", "PaddingWaste"] == ("Unquantified", False) and p["u", "Straddle"][1] is True and p["h", "HotPlacement"] == ("Measured", False)
    bits = spark.createDataFrame([("b", 0, "c", 0, 1, None, None), ("b", 1, "x", 4, 4, 0, 3), ("b", 2, "y", 4, 4, 3, 7), ("b", 3, "z", 4, 4, 10, 0), ("b", 4, "i", 8, 4, None, None)], "tag string, ord int, name string, offset long, size long, bit_offset long, bit_width long")
    assert sorted((x.name, x.offset, x.size) for x in layout.effective_members(bits).collect()) == [("c", 0, 1), ("i", 8, 4), ("x", 4, 2)]


def test_findings(spark):
    f = spark.createDataFrame([(1, "null-dereference: a", 5, False), (2, "null-dereference: a longer", 5, False), (3, "null-dereference: b", 6, False), (4, "out-of-bounds: c", 5, False), (5, "out-of-bounds: d", 7, True)], "ord long, message string, line int, invented_bound boolean")
    f = f.withColumn("kind", findings.kind_of(F.col("message")))
    got = {(r.kind, r.line): (r.paths, r.message) for r in findings.grouped(f, ["kind", "line"]).collect()}
    assert got == {("null-dereference", 5): (2, "null-dereference: a longer"), ("null-dereference", 6): (1, "null-dereference: b"), ("out-of-bounds", 5): (1, "out-of-bounds: c")}
    assert findings.suppressed(f).first().suppressed == 1
    b = spark.createDataFrame([(1, i, "ab"[i % 2], i == 4) for i in range(5)] + [(2, 0, "a", False)], "finding int, ord int, label string, pinned boolean")
    d = {r.finding: r for r in findings.witness_digest(b, 2).collect()}
    assert d[1].shown == [4, 0] and d[1].omitted == 3 and d[1].pinned_omitted == 0 and [(x.label, x.n) for x in d[1].omitted_by_label] == [("b", 2), ("a", 1)]
    assert d[2].shown == [0] and d[2].omitted == 0
    s = spark.createDataFrame([("exact", False), ("bounded", False)], "fidelity string, errored boolean")
    assert findings.worst_fidelity(s).first().fidelity == "bounded"
    assert findings.worst_fidelity(s.withColumn("errored", F.lit(True))).first().fidelity == "unknown"


def test_sweep_matrix(spark):
    ours = ("Clean", "Advised", "Diagnosed", "Warned", "NotRun")
    want = {"Clean": ("Agree", "Finding", "Finding", "Finding", "ToolGap"), "Warned": ("Miss", "Agree", "SeverityMismatch", "SeverityMismatch", "ToolGap"), "Diagnosed": ("Miss", "BothRefused", "BothRefused", "BothRefused", "ToolGap"), "Advised": ("ToolGap",) * 5, "NotRun": ("ToolGap",) * 5}
    df = spark.createDataFrame([(t, o) for t in want for o in ours], "theirs string, ours string").withColumn("b", sweep.bucket(F.col("theirs"), F.col("ours")))
    assert {(r.theirs, r.ours): r.b for r in df.collect()} == {(t, o): w for t, row in want.items() for o, w in zip(ours, row, strict=True)}
    stages = spark.createDataFrame([(str(i), s) for i, s in enumerate((3, 3, 3, 2, 1, 1, 0, 0, 0, 0))], "path string, stage int")
    assert tuple(sweep.parser_coverage(stages).first()) == (10, 6, 4, 66.7)
    assert sweep.parser_coverage(stages.where("stage = 0")).first().percent == 0


# Sources, functions, envelope ---------------------------------------------------------------------------------------------


def test_build_database(spark, tmp_path):
    base = "gcc -DA -D 'F=\"a b\"' -Ix -Iy -c a.c -o a.o"
    doc = [{"file": "a.c", "directory": "/w", "command": f"{base} -march=x86-64-v2"}, {"file": "a.c", "directory": "/w", "command": f"{base} -march=x86-64-v3 -include x.h"}, {"file": "a.c", "directory": "/w", "command": base.replace("-Ix -Iy", "-Iy -Ix")}, {"file": "p", "directory": "/w", "command": ""}]
    import json

    p = tmp_path / "db.json"
    p.write_text(json.dumps(doc))
    entries = compdb.read_entries(spark, str(p))
    tu = compdb.units(entries).cache()
    assert tu.count() == 3 and compdb.phony(entries).first().phony == 1
    r = tu.orderBy(F.array_join("target_flags", " ")).collect()
    assert list(r[1].defines) == ["A=1", "F=a b"] or list(r[1].defines) == ["A=1", 'F="a b"']
    assert builds.distinct_configs(tu).first().configs == 2
    assert builds.flag_sets(tu).count() == 3
    assert [list(x.unhandled) for x in r if x.unhandled] == [["-include x.h"]]
    p.write_text('{"file": "a.c"}')
    with pytest.raises(Exception, match="not an array"):
        compdb.read_entries(spark, str(p)).collect()


def test_manifest_and_corpus(spark, tmp_path):
    p = tmp_path / "m.tsv"
    p.write_text("# c\nt1\t/a\nt2\t/b\nt1\t/c\n")
    assert rows(files.read_manifest(spark, str(p))) == [("t1", "/a", 0), ("t1", "/c", 0), ("t2", "/b", 1)]
    p.write_text("# only\n")
    with pytest.raises(files.EmptySource):
        files.read_manifest(spark, str(p))


def test_globs_and_paths(spark):
    import re

    for glob, yes, no in (("src/**/*.c", ["src/a.c", "src/x/y/a.c"], ["a.c", "src/a.h"]), ("a?c", ["abc"], ["a/c", "abbc"]), ("*.c", ["a.c"], ["x/a.c", "axc"])):
        r = re.compile(paths.glob_to_regex(glob))
        assert all(r.search(x) for x in yes) and not any(r.search(x) for x in no)
    df = spark.createDataFrame([("a/./b//../c",), ("x/../../y",), ("./",)], "p string")
    assert [r[0] for r in df.select(paths.normalized(F.col("p"))).collect()] == ["a/c", "../y", "."]
    assert df.select(paths.normalized(F.col("p"), keep_parents=True)).first()[0] == "a/b/../c"
    assert spark.range(1).select(paths.stripped(F.lit("/a/b/c.h"), 2)).first()[0] == "c.h"
    assert spark.range(1).select(paths.rerooted(F.lit("/a/b/c.h"), 1, "/r")).first()[0] == "/r/b/c.h"


def test_array_helpers(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 9, 4]), ([1], [1]), ([], [5])], "a array<int>, b array<int>")
    got = df.select(facts.common_prefix(F.col("a"), F.col("b")), facts.common_suffix(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(2, 1), (1, 0), (0, 0)]
    assert [r[0] for r in spark.range(1, 10).select(facts.next_power_of_two(F.col("id"))).collect()] == [1, 2, 4, 4, 8, 8, 8, 8, 16]


def test_intervals_of_any_length(spark):
    spans = [(0, 0, 3), (1, 2, 5000), (2, 7, 8), (3, 100, 100)]
    points = spark.createDataFrame([(0, p) for p in (0, 2, 3, 7, 100, 4999, 5000)], "k int, at int")
    got = intervals.containing(points, spark.createDataFrame([(0, i, a, b) for i, a, b in spans], "k int, i int, lo int, hi int"), ["k"], "at", "lo", "hi", 4)
    assert rows(got.select("at", "i")) == sorted(((p, i) for p in (0, 2, 3, 7, 100, 4999, 5000) for i, a, b in spans if a <= p < b), key=repr)


def test_envelope(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    e = Envelope("op", df)
    assert e.proven and not e.downgrade(Fidelity.bounded, "r").proven
    assert e.downgrade(Fidelity.unknown).downgrade(Fidelity.bounded).fidelity is Fidelity.unknown
    assert e.truncated(10, 2, 2).fidelity is Fidelity.bounded and e.truncated(2, 2, None) is e
    assert e.key().first() == Envelope("op", df.orderBy(F.desc("x")).repartition(3)).key().first()
    assert e.key().first() != Envelope("op", df.limit(1)).key().first()
    assert [r.json for r in e.body().collect()] == ['{"x":1,"y":"a"}', '{"x":2,"y":null}']
    assert "unknown" in e.aborted("clock").text() and e.aborted("clock").nondeterministic_abort


def test_preprocessor():
    u, found = csource.analyzed("a.c", {"a.c": '#define CAT(a,b) a##b\n#define STR(x) #x\n#define ADD(a, ...) f(a, __VA_ARGS__)\n#if defined(CAT) && (1 << 3) == 8\nint CAT(x,1) = ADD(1, 2, 3);\nchar *s = STR(a b);\n#else\nint no;\n#endif\n'})
    assert "".join(t.text for t in u.tokens) == 'intx1=f(1,2,3);char*s="a b";' and u.clean
    assert [e.name for e in found if e.kind == "Global"] == ["x1", "s"]
    u, _ = csource.analyzed("a.c", {"a.c": "#define A B\n#define B A\nint A;\n"})
    assert [t.text for t in u.tokens] == ["int", "A", ";"]
    u, _ = csource.analyzed("a.c", {"a.c": '#include "none.h"\nint x;'})
    assert not u.clean
    same = lambda s: [(e.name, e.head, e.tail) for e in csource.analyzed("a.c", {"a.c": s})[1]]
    assert same("int f(int a){return a;}\n") == same("/* c */ int f( int a )\n{\n  return a; // x\n}\n")


def test_streaming_equals_batch(spark, tmp_path):
    import json

    data = [{"file": "x.c", "line": i % 7, "variant": "", "test": i % 3, "count": i % 4} for i in range(50)]
    src = tmp_path / "in"
    src.mkdir()
    for part in (0, 1):
        (src / f"{part}.json").write_text("\n".join(json.dumps(d) for d in data[part::2]))
        ingest.ingest_records(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    from tracewell.operators.coverage import coverage_sets, tests_for_lines

    batch = spark.createDataFrame([(d["file"], d["line"], d["variant"], d["test"], d["count"]) for d in data], "file string, line int, variant string, test int, count int")
    assert rows(tests_for_lines(ingest.index(spark, str(tmp_path / "out")))) == rows(tests_for_lines(coverage_sets(batch)))


def test_fixed_width_integers_equal_python(spark):
    rng = random.Random(3)
    for w in (1, 8, 33, 64):
        m, half = 1 << w, 1 << (w - 1)
        signed = lambda v: (v + half) % m - half  # noqa: B023, E731
        some = [signed(v) for v in (0, 1, -1, half, half - 1, 5)] + [signed(rng.getrandbits(w)) for _ in range(30)]
        pairs = [(a, b) for a in some for b in rng.sample(some, 4) + [signed(0), signed(-1)]]
        df = spark.createDataFrame(pairs, "a long, b long")
        got = df.select("a", "b", *(f(F.col("a"), F.col("b"), w).alias(n) for n, f in bits.BINARY.items()), *(f(F.col("a"), F.col("b"), w).alias(n) for n, f in bits.COMPARE.items()), *(bits.overflows(o, F.col("a"), F.col("b"), w).alias(f"o{o}") for o in ("Add", "Sub", "Mul")), bits.popcount(F.col("a"), w).alias("pop"), bits.leading_zeros(F.col("a"), w).alias("clz"), bits.UNARY["Neg"](F.col("a"), w).alias("neg")).collect()
        for r in got:
            a, b, ua, ub = r.a, r.b, r.a % m, r.b % m
            div = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1) if b else 1 if a < 0 else -1
            want = {"Add": a + b, "Sub": a - b, "Mul": a * b, "UDiv": ua // ub if ub else -1, "SDiv": div, "URem": ua % ub if ub else a, "SRem": a - b * div if b else a, "And": a & b, "Or": a | b, "Xor": a ^ b}
            want |= {"Shl": a << b if 0 <= b < w else 0, "LShr": ua >> b if 0 <= b < w else 0, "AShr": a >> b if 0 <= b < w else -1 if a < 0 else 0}
            assert {k: getattr(r, k) for k in want} == {k: signed(v) for k, v in want.items()}, (w, a, b)
            assert (r.ULt, r.UGe, r.SLt, r.Eq) == (ua < ub, ua >= ub, a < b, a == b)
            assert [r.oAdd, r.oSub, r.oMul] == [v != signed(v) for v in (a + b, a - b, a * b)]
            assert (r["pop"], r.clz, r.neg) == (ua.bit_count(), w - ua.bit_length() if a else None, signed(-a))


def test_floats_compare_as_ordered_and_unordered(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, 2.0), (nan, 1.0), (nan, nan), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (7.5, 2.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    rows = df.select(*(f(a, b).alias(n) for n, f in {**bits.FLOAT_COMPARE, **bits.FLOAT_BINARY}.items())).collect()
    assert [r.FOEq for r in rows] == [False, False, False, False, False, True, False]
    assert [r.FUEq for r in rows] == [False, True, True, False, False, True, False]
    assert [r.FOLt for r in rows] == [True, False, False, False, True, False, False]
    assert [r.FUno for r in rows] == [False, True, True, False, False, False, False]
    assert rows[3].FDiv == inf and rows[4].FDiv == -inf and rows[5].FDiv != rows[5].FDiv and rows[6].FDiv == 3.75 and rows[6].FRem == 1.5


def test_cycles_and_dominators_of_small_graphs(spark):
    edges = lambda *e: spark.createDataFrame([*e], "src int, dst int")
    found = lambda *e: {r.node: r.component for r in graphs.cycles(edges(*e)).collect()}
    assert found((1, 2), (2, 3)) == {}
    assert found((1, 1)) == {1: 1}
    assert found((1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (0, 1)) == {1: 2, 2: 2, 3: 4, 4: 4}
    assert found((1, 9), (9, 1), (9, 2), (2, 3), (3, 2)) == {1: 9, 9: 9, 2: 3, 3: 3}
    f = spark.createDataFrame([("f", 0, 1), ("f", 1, 2), ("f", 1, 3), ("f", 2, 4), ("f", 3, 4), ("f", 4, 1), ("f", 8, 4)], "func string, src int, dst int")
    entry = spark.createDataFrame([("f", 0)], "func string, node int")
    assert {(r.node, r.dominator) for r in graphs.dominators(f, entry).where("immediate").collect()} == {(1, 0), (2, 1), (3, 1), (4, 1)}
    blocks = spark.createDataFrame([("f", k) for k in (0, 1, 2, 3, 4, 8)], "func string, node int")
    assert [r.node for r in graphs.unreachable(blocks, f, entry).collect()] == [8]


# Constraints, domains, literals, personas --------------------------------------------------------------------------


def test_constraints_split_by_shared_variables(spark):
    m = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "b"), ("q", "c"), ("r", "x"), ("r", "x"), ("s", None), ("t", "y"), ("t", "x")], "constraint string, var string")
    asked = spark.createDataFrame([("c",), ("c",), ("unknown",), (None,)], "var string")
    assert rows(constraints.split(m, asked)) == rows(spark.createDataFrame([("p", "a", True), ("q", "a", True), ("r", "x", False), ("s", None, False), ("t", "x", False)], "constraint string, component string, relevant boolean"))
    assert rows(constraints.split(m.limit(0), asked)) == []


def test_contained_sets_equal_brute_force(spark):
    rng = random.Random(5)
    a = {k: {rng.randrange(12) for _ in range(rng.randint(0, 4))} for k in range(60)}
    b = {k: {rng.randrange(12) for _ in range(rng.randint(0, 9))} for k in range(60)}
    df = lambda s: spark.createDataFrame([(k, x) for k, v in s.items() for x in v] * 2 + [(0, None)], "set int, item int")
    assert rows(constraints.contained(df(a), df(b))) == sorted(((i, j) for i in a for j in b if a[i] and a[i] <= b[j]), key=repr)


def test_domains_keep_every_value_that_can_occur(spark):
    w, rng = 4, random.Random(3)
    picks = [tuple(sorted(rng.sample(range(16), rng.randint(1, 5)))) for _ in range(60)]
    pairs = [(list(x), list(y)) for x in picks for y in rng.sample(picks, 6)]

    def domain(c):
        out = None
        for k in range(5):
            one = domains.constant(F.col(c)[F.least(F.lit(k), F.size(c) - 1)], w)
            out = one if out is None else domains.join(out, one, w)
        return domains.reduced(out, w)

    df = spark.createDataFrame(pairs, "x array<long>, y array<long>").select("*", domain("x").alias("dx"), domain("y").alias("dy"))
    ops = {"Add": lambda a, b: a + b, "Sub": lambda a, b: a - b, "And": lambda a, b: a & b, "Or": lambda a, b: a | b, "Xor": lambda a, b: a ^ b}
    got = df.select("x", "y", *(domains.reduced(f(F.col("dx"), F.col("dy"), w), w).alias(n) for n, f in domains.BINARY.items()), domains.meet(F.col("dx"), F.col("dy"), w).alias("meet"), domains.empty(domains.meet(F.col("dx"), F.col("dy"), w)).alias("none"), domains.complement(F.col("dx"), w).alias("Not")).collect()
    inside = lambda v, d: d.lo <= v <= d.hi and not v & d.zeros and not ~v & d.ones
    for r in got:
        for n, f in ops.items():
            assert all(inside(f(a, b) % 16, r[n]) for a in r.x for b in r.y), (n, r)
        assert all(inside(v, r.meet) for v in set(r.x) & set(r.y)) and not (r.none and set(r.x) & set(r.y))
        assert all(inside(15 - a, r.Not) for a in r.x)
    narrow = spark.range(1).select(domains.BINARY["And"](domains.top(8), domains.constant(F.lit(12), 8), 8).alias("d"), domains.between(F.lit(8), F.lit(11), 8).alias("e"), domains.admits(domains.top(8), F.lit(200), 8).alias("f")).first()
    assert (narrow.d.hi, narrow.d.zeros, narrow.e.ones, narrow.e.zeros, narrow.f) == (12, 0xF3, 8, 0xF4, True)


@pytest.mark.parametrize(
    "literal, want",
    [
        ('"ab"', (1, [97, 98], False, None)),
        ('""', (1, [], False, None)),
        (r'"\n\x41\101\0"', (1, [10, 65, 65, 0], False, None)),
        (r'"\1234"', (1, [83, 52], False, None)),
        (r'"\x1ff"', (1, [255], True, None)),
        (r'u"\x1ff"', (2, [511], False, None)),
        ('"é"', (1, [0xC3, 0xA9], False, None)),
        ('u"😀"', (2, [0xD83D, 0xDE00], False, None)),
        (r'U"\U0001F600"', (4, [0x1F600], False, None)),
        (r'u8"\u00e9"', (1, [0xC3, 0xA9], False, None)),
        (r'L"\uD800"', (4, [], False, "code point")),
        (r'"\q"', (1, [], False, "escape")),
        (r'"\xg"', (1, [], False, "escape")),
        ('"a', (0, [], False, "unterminated")),
        ('"a"b"', (1, [], False, "unterminated")),
        (r"'\''", (1, [39], False, None)),
    ],
)
def test_literals(literal, want):
    assert literals.decoded(literal) == want


def test_literal_units_of_a_column(spark):
    df = spark.createDataFrame([('"a"',), (None,), ('""',)], "s string").select(literals.literal_units("s").alias("u"))
    assert [(r.u.units, r.u.error) for r in df.collect()] == [([97], None), ([], "null"), ([], None)]


def test_personas(spark, tmp_path):
    one, two = "#define A 1\n#define F(x, y) x y\n#define E\n#define V(...) f(__VA_ARGS__)\nnoise\n", "#define A 2\n#define E\n#  define F(x,y)   x y  \n"
    (tmp_path / "a").write_text(one)
    (tmp_path / "b").write_text(two)
    got = persona.scan(spark, str(tmp_path))
    at = {r.path.rsplit("/", 1)[1]: r.path for r in got.select("path").distinct().collect()}
    assert sorted((r.name, r.params, r.body) for r in got.where(F.col("path") == at["a"]).collect()) == [("A", None, "1"), ("E", None, ""), ("F", ["x", "y"], "x y"), ("V", ["..."], "f(__VA_ARGS__)")]
    assert sorted((r.name, r.ours and r.ours.body, r.theirs and r.theirs.body) for r in persona.differing(got, at["a"], at["b"]).collect()) == [("A", "1", "2"), ("V", "f(__VA_ARGS__)", None)]
    unit, found = csource.analyzed("t.c", {"t.c": "#if A == 1\nint F(a, b);\n#endif\nint c = A;\n"}, persona=one)
    assert unit.clean and [e.name for e in found][-1:] == ["c"] and not unit.macros


def test_states_complete_in_order_of_their_ids(spark):
    s = spark.createDataFrame([(3, "x"), (1, "y"), (2, "z")], "state int, outcome string")
    assert [r.state for r in findings.completion(s).collect()] == [1, 2, 3]
