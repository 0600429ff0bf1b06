"""Which tests to run for a change, with every reason, and how far to trust the choice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.coverage import always_run
from tracewell.operators.impact import KEY, Completeness

#: Score of a test that no coverage reason selects.
FAR = 2147483647


def refined(impacted: DataFrame, verdicts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """impacted without, and with only, the entities proven equivalent: an exact verdict alone removes one."""
    if verdicts is None:
        return impacted, impacted.limit(0)
    proven = verdicts.where("verdict = 'Equivalent' and fidelity = 'exact'").select(*KEY).distinct()
    return impacted.join(proven, KEY, "left_anti"), impacted.join(proven, KEY, "left_semi")


def covered_by(impacted: DataFrame, entity_lines: DataFrame, tests_of: DataFrame) -> DataFrame:
    """test, reason, distance, why: the tests that executed a line of an impacted entity.

    tests_of is (file, line, tests) with null for unattributed lines.
    """
    lines = impacted.join(entity_lines.select(*KEY, "line").distinct(), KEY)
    ran = tests_of.select("file", "line", F.explode("tests").alias("test"))
    hit = lines.join(ran, ["file", "line"])
    return hit.groupBy("test", *KEY).agg(F.min("distance").alias("distance")).select("test", F.lit("Covers").alias("reason"), "distance", F.concat_ws(":", *KEY).alias("why"))


def unmatched(impacted: DataFrame, entity_lines: DataFrame, tests_of: DataFrame) -> DataFrame:
    """KEY, why: impacted entities that coverage can't answer for, and which of three ways."""
    lined = impacted.select(*KEY).join(entity_lines.select(*KEY, "line").distinct(), KEY, "left")
    known_files = tests_of.select("file").distinct().withColumn("known", F.lit(True))
    told = lined.join(known_files, "file", "left").join(tests_of.select("file", "line", F.lit(True).alias("seen")), ["file", "line"], "left")
    per = told.groupBy(*KEY).agg(F.max("line").alias("any"), F.max("known").alias("known"), F.max("seen").alias("seen"))
    return per.select(*KEY, F.when(F.col("any").isNull(), "no line").when(F.col("known").isNull(), "file not in index").when(F.col("seen").isNull(), "no coverage").alias("why")).where("why is not null")


def safety_set(tests: DataFrame, tests_of: DataFrame, suite: DataFrame | None = None, validity: str = "Fresh", missing: DataFrame | None = None, complete: bool = True) -> DataFrame:
    """test, reason, distance, why of what must run whatever changed; each trigger is its own row."""
    row = lambda d, why: d.select("test", F.lit("AlwaysRun").alias("reason"), F.lit(None).cast("int").alias("distance"), F.lit(why).alias("why"))
    indexed = tests.where("ingested").select("test")
    lined = tests_of.select(F.explode("tests").alias("test")).distinct()
    found = row(always_run(tests), "no complete coverage").unionByName(row(indexed.join(lined, "test", "left_anti"), "no line attributed"))
    if suite is not None:
        found = found.unionByName(row(suite.select("test").distinct().join(indexed, "test", "left_anti"), "never measured"))
    if validity == "Stale":
        found = found.unionByName(row(indexed, "index is stale"))
    if validity == "Partial" and missing is not None:
        found = found.unionByName(row(missing.select("test"), "no complete coverage of this test"))
    if not complete:
        found = found.unionByName(row(indexed, "impact is incomplete"))
    return found.distinct()


def selected(reasons: DataFrame) -> DataFrame:
    """test, score, n_reasons, only_always: one row for each test that any reason selects."""
    return reasons.distinct().groupBy("test").agg(F.coalesce(F.min(F.when(F.col("reason") != "AlwaysRun", F.col("distance"))), F.lit(FAR)).alias("score"), F.count("*").alias("n_reasons"), F.every(F.col("reason") == "AlwaysRun").alias("only_always"))


def with_reasons(order: DataFrame, reasons: DataFrame) -> DataFrame:
    """rank, test, reason, distance, why: every reason of every ranked test as a row, so that no test's list is in one place."""
    return order.select("test", "rank").join(reasons.distinct(), "test").select("rank", "test", "reason", "distance", "why")


def ranked(chosen: DataFrame) -> DataFrame:
    """chosen with rank from 1 by (score, test).

    Ranks within equal scores are counted per score, whose number of values is small, and shifted by the sizes of better
    scores: no task sorts all tests.
    """
    sizes = chosen.groupBy("score").agg(F.count("*").alias("n"))
    shift = sizes.select("score", (F.sum("n").over(Window.orderBy("score")) - F.col("n")).alias("before"))  # a row a score
    own = F.row_number().over(Window.partitionBy("score").orderBy("test"))
    return chosen.withColumn("own", own).join(shift, "score").select(*chosen.columns, (F.col("own") + F.col("before")).cast("int").alias("rank"))


def within_budget(order: DataFrame, budget: int) -> DataFrame:
    return order.where(F.col("rank") <= budget)


def budget_effect(order: DataFrame, budget: int) -> DataFrame:
    """One row: kept, dropped, confidence (Reduced only if something was dropped)."""
    return order.agg(F.count_if(F.col("rank") <= budget).alias("kept"), F.count_if(F.col("rank") > budget).alias("dropped")).select("kept", "dropped", F.when(F.col("dropped") > 0, "Reduced").otherwise("Full").alias("confidence"))


def excluded(proven: DataFrame, entity_lines: DataFrame, tests_of: DataFrame, chosen: DataFrame) -> DataFrame:
    """test, entity: tests that only proven entities would have selected, with the first of these for the audit."""
    would = covered_by(proven, entity_lines, tests_of).join(chosen.select("test"), "test", "left_anti")
    return would.groupBy("test").agg(F.min("why").alias("entity"))


@dataclass(frozen=True)
class Confidence:
    reasons: tuple[str, ...] = ()

    @property
    def full(self) -> bool:
        return not self.reasons


def confidence(gaps: Completeness, validity: str = "Fresh", files: tuple[str, ...] = (), dropped: int = 0, unmatched_entities: int = 0) -> Confidence:
    """Full only if there is nothing to say against the selection."""
    told = []
    if validity == "Stale":
        told.append(f"stale: {', '.join(sorted(files))} changed since coverage was recorded")
    if validity == "Partial":
        told.append("coverage of some tests is incomplete")
    if gaps.unparsed_files:
        told.append(f"not parsed: {', '.join(gaps.unparsed_files)}")
    if gaps.address_taken_fallbacks:
        told.append(f"{gaps.address_taken_fallbacks} indirect calls by address only")
    if gaps.unresolved_calls:
        told.append(f"{gaps.unresolved_calls} calls unresolved")
    if gaps.unknown_configs:
        told.append(f"conditions changed: {', '.join(gaps.unknown_configs)}")
    if unmatched_entities:
        told.append(f"{unmatched_entities} impacted entities without coverage to consult")
    if dropped:
        told.append(f"{dropped} selected tests over the budget")
    return Confidence(tuple(told))


def recall(mutations: DataFrame, chosen: DataFrame, suite_size: int) -> DataFrame:
    """One row of totals over mutations: required, hit, recall, n_selected, reduction.

    mutations is (mutation, test) of tests that fail, chosen (mutation, test) of tests selected. Ratios are of totals, and null over nothing.
    """
    both = mutations.distinct().withColumn("need", F.lit(1)).join(chosen.distinct().withColumn("got", F.lit(1)), ["mutation", "test"], "full_outer")
    t = both.agg(F.count("need").alias("required"), F.count_if(F.col("need").isNotNull() & F.col("got").isNotNull()).alias("hit"), F.count("got").alias("n_selected"), F.countDistinct("mutation").alias("mutations"))
    return t.select("required", "hit", F.try_divide("hit", "required").alias("recall"), "n_selected", F.try_divide(F.col("mutations") * suite_size - F.col("n_selected"), F.col("mutations") * suite_size).alias("reduction"))


def baseline(changed_lines: DataFrame, tests_of: DataFrame) -> DataFrame:
    """mutation, test: what a line-coverage tool selects for the changed (mutation, file, line) alone."""
    return changed_lines.join(tests_of.select("file", "line", F.explode("tests").alias("test")), ["file", "line"]).select("mutation", "test").distinct()
