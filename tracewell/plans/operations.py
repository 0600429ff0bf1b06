"""The public operations: fact tables in, an Envelope out that says what the answer is worth.

`Facts` names the tables an operation may use; a missing one is a blind spot, not an empty answer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.envelope import Envelope, Fidelity
from tracewell.operators import coverage, findings, impact, layout, selection, sites
from tracewell.sources import csource


class RequestError(ValueError):
    """A malformed request, as opposed to one that can't be answered."""


@dataclass
class Facts:
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def need(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise RequestError(f"the table {name} is needed")
        return self.tables[name]

    def get(self, name: str) -> DataFrame | None:
        return self.tables.get(name)


def _impact(f: Facts) -> tuple[DataFrame, impact.Completeness]:
    before, after = f.need("before"), f.need("after")
    shapes = [f.get(n) for n in ("record_before", "record_after", "field_before", "field_after")]
    records = impact.record_changes(*shapes) if all(x is not None for x in shapes) else None
    changed = impact.classified(impact.entity_diff(csource.fingerprints(before), csource.fingerprints(after)), records)
    edges = csource.edges(before).unionByName(csource.edges(after, 1 << 40))
    both = before.unionByName(after)
    unclean = both.where("fact = 'status' and not clean").select("file").distinct()
    files = tuple(sorted(r["file"] for r in unclean.collect()))  # units of the change
    condition = lambda d: d.where("fact = 'condition'").select("tu", "ord", F.col("name").alias("directive"), F.col("head").alias("tokens"))
    conditions = tuple(r["text"] for r in impact.changed_conditions(condition(before), condition(after)).select(F.coalesce("new", "old").alias("text")).collect())
    taken = both.where("fact = 'address_taken'").select(F.col("other").alias("name")).distinct()
    arity = after.where("fact = 'fingerprint' and kind = 'Function'").select("name", "params", "variadic").dropDuplicates(["name"])
    indirect = None
    if f.get("indirect_site") is not None:
        indirect = impact.indirect_holders(changed, f.need("indirect_site"), arity, taken)
    entities = both.where("fact = 'fingerprint'").select(*impact.KEY).distinct()
    found = impact.impact(changed, edges, entities, unclean, bool(conditions), indirect)
    fallbacks = indirect.count() if indirect is not None else 0
    return found, impact.Completeness(files, 0, conditions, fallbacks)


def impact_of(f: Facts) -> Envelope:
    """What a change from `before` to `after` (csource facts) reaches."""
    found, gaps = _impact(f)
    out = Envelope("impact", impact.in_report_order(found), notes={"complete": gaps.complete})
    if gaps.complete:
        return out
    return out.downgrade(Fidelity.bounded, "; ".join(selection.confidence(gaps).reasons))


def select_tests(f: Facts, budget: int | None = None, reasons: bool = False) -> Envelope:
    """Ranked tests to run for the change; needs before, after, sets (coverage index) and test.

    With reasons, a row for each reason of each test: the entity whose lines it executed and at which distance, or why it must run.
    """
    found, gaps = _impact(f)
    tests_of, tests = coverage.tests_for_lines(f.need("sets")), f.need("test")
    state, stale, missing = "Fresh", (), None
    if f.get("recorded") is not None and f.get("current") is not None:
        v = coverage.validity(f.need("recorded"), f.need("current"), tests).first()
        state, stale = v["state"], tuple(v["files"])
        missing = coverage.always_run(tests)
    kept, proven = selection.refined(found, f.get("verdict"))
    lines = csource.entity_lines(f.need("after"))
    why = selection.covered_by(kept, lines, tests_of).unionByName(selection.safety_set(tests, tests_of, f.get("suite"), state, missing, gaps.complete))
    order = selection.ranked(selection.selected(why))
    odd = selection.unmatched(kept.where("kind <> 'Macro'"), lines, tests_of).where("why = 'file not in index'").count()
    dropped = 0
    if budget is not None:
        dropped = selection.budget_effect(order, budget).first()["dropped"]
        order = selection.within_budget(order, budget)
    trust = selection.confidence(gaps, state, stale, dropped, odd)
    if f.get("name") is not None:
        order = order.join(f.need("name"), "test", "left")
    if reasons:
        order = selection.with_reasons(order, why)
    out = Envelope("select-tests", order.orderBy("rank", *(["reason", "why"] if reasons else [])), notes={"confidence": "Full" if trust.full else "Reduced"})
    out = out.downgrade(Fidelity.bounded, "tests are told by the lines that they executed")
    for reason in trust.reasons:
        out = out.downgrade(Fidelity.unknown, reason)
    return out


def expansion_sites(f: Facts, macro: str, cursor: int = 0, limit: int = 100) -> Envelope:
    if cursor < 0 or limit < 1:
        raise RequestError("a page starts at 0 or later and has one row at least")
    found = sites.distinct_sites(f.need("expansion"), macro)
    total = found.count()
    shown = max(0, min(limit, total - cursor))
    return Envelope("expansion-sites", sites.paged(found, sites.PLACE, cursor, limit), notes={"total": total}).truncated(total, shown, sites.page_end(total, cursor, limit))


def explain_macro(f: Facts, file: str, line: int) -> Envelope:
    e = f.need("expansion")
    out = Envelope("explain-macro", sites.explained(e, file, line))
    known = f.get("file")
    there = (known if known is not None else e.select("file")).where(F.col("file") == file).limit(1).count()
    return out if there else out.downgrade(Fidelity.unknown, f"{file} isn't among the files read")


def layout_of(f: Facts, line: int = 64) -> Envelope:
    out = Envelope("layout", layout.proposals(f.need("member"), f.need("record"), f.get("access"), line))
    return out.downgrade(Fidelity.bounded, "sizes are of one target") if f.get("access") is not None else out.downgrade(Fidelity.bounded, "no access counts").unseen("which fields are hot")


def find_bugs(f: Facts) -> Envelope:
    """Findings of a symbolic run, deduplicated and grouped by kind and place."""
    rows = findings.deduplicated(f.need("finding"))
    out = Envelope("find-bugs", findings.grouped(rows, ["kind", "file", "line"]).orderBy("kind", "file", "line"))
    hidden = findings.suppressed(rows).first()["suppressed"]
    if hidden:
        out = out.downgrade(Fidelity.bounded, f"{hidden} findings rest on a bound that was invented, and aren't shown")
    if f.get("state") is not None:
        out = out.downgrade(Fidelity[findings.worst_fidelity(f.need("state")).first()["fidelity"]])
    return out


def check_reachable(f: Facts, exhaustive: bool = False) -> Envelope:
    out = Envelope("check-reachable", findings.reachability(f.need("asked"), f.need("block_line"), f.need("trace"), F.lit(exhaustive)))
    return out if exhaustive else out.downgrade(Fidelity.bounded, "the search wasn't exhaustive")


def _table(name: str, table: str) -> Callable[[Facts], Envelope]:
    """Operations whose answers another engine computes: its verdicts are taken over with their fidelity."""

    def run(f: Facts) -> Envelope:
        rows = f.need(table)
        worst = findings.worst_fidelity(rows.select("fidelity", F.lit(False).alias("errored"))).first()["fidelity"]
        return Envelope(name, rows).downgrade(Fidelity[worst])

    return run


OPERATIONS: dict[str, Callable[..., Envelope]] = {
    "impact": impact_of,
    "select-tests": select_tests,
    "expansion-sites": expansion_sites,
    "explain-macro": explain_macro,
    "layout": layout_of,
    "find-bugs": find_bugs,
    "check-reachable": check_reachable,
    "prove-equivalent": _table("prove-equivalent", "verdict"),
    "find-optimizations": _table("find-optimizations", "proposal"),
}


def run(name: str, facts: Facts, **arguments: Any) -> Envelope:
    if name not in OPERATIONS:
        raise RequestError(f"unknown operation {name!r}")
    try:
        return OPERATIONS[name](facts, **arguments)
    except TypeError as e:
        raise RequestError(str(e)) from e
