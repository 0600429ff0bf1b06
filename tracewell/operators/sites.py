"""Macro expansion: where macros are used, through which chains, and paging over it.

expansion is (tu, ctx, parent, macro, file, line, col, item_line, item_col): one row an expansion, parent null at the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.fixpoint import roots, upward

PLACE = ["file", "line", "col", "item_line", "item_col"]


def expansion_depth(parents: DataFrame) -> DataFrame:
    """node, root, depth."""
    return roots(parents)


def _parents(expansion: DataFrame) -> DataFrame:
    return expansion.select(F.struct("tu", "ctx").alias("node"), F.when(F.col("parent").isNotNull(), F.struct("tu", F.col("parent").alias("ctx"))).alias("parent"))


def chains(expansion: DataFrame, wanted: DataFrame) -> DataFrame:
    """tu, ctx, chain: macro names from the expansion out to its root, for each wanted (tu, ctx)."""
    node = F.struct("tu", "ctx")
    names = expansion.select(node.alias("node"), "macro")
    up = upward(wanted.select(node.alias("node")).distinct().join(names, "node", "left_semi"), _parents(expansion))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("depth", "macro"))), lambda x: x["macro"])
    return up.join(names, "node").groupBy("start").agg(listed.alias("chain")).select("start.tu", "start.ctx", "chain")


def leaves_at(expansion: DataFrame, matched: DataFrame) -> DataFrame:
    """Of matched (tu, ctx): those that are no ancestor of another matched one."""
    node = F.struct("tu", "ctx")
    inner = upward(matched.select(node.alias("node")), _parents(expansion)).where("depth > 0").select("node.tu", "node.ctx").distinct()
    return matched.join(inner, ["tu", "ctx"], "left_anti")


def explained(expansion: DataFrame, file: str, line: int) -> DataFrame:
    """The chain of each innermost expansion written at a line, in written order."""
    here = expansion.where((F.col("file") == file) & (F.col("line") == line))
    leaf = leaves_at(expansion, here.select("tu", "ctx").distinct())
    return chains(expansion, leaf).join(expansion.select("tu", "ctx", *PLACE), ["tu", "ctx"]).orderBy("line", "col", "item_line", "item_col", "tu", "ctx")


def involves(chain: Column, macro: str) -> Column:
    return F.array_contains(chain, macro)


def distinct_sites(expansion: DataFrame, macro: str) -> DataFrame:
    return expansion.where(F.col("macro") == macro).select(*PLACE).distinct()


def paged(rows: DataFrame, order: list[str], cursor: int, limit: int) -> DataFrame:
    """A page of rows in a total order. Sorted and cut by Spark, so only the page is ever in one place."""
    return rows.orderBy(*order).offset(cursor).limit(limit)


def page_end(total: int, cursor: int, limit: int) -> int | None:
    """The next cursor; none at the end, or past it."""
    return cursor + limit if cursor + limit < total else None


def cooked(sites: DataFrame) -> DataFrame:
    """Sites across translation units under text keys, each at its least depth, with how many rows that replaces."""
    return sites.groupBy("macro_file", "macro", "def_line", "file", "line", "config").agg(F.min("depth").alias("depth"), (F.count("*") - 1).alias("dropped"))


def sites_of(index: DataFrame, macro_file: str, macro: str, config: int | None = None) -> DataFrame:
    found = index.where((F.col("macro_file") == macro_file) & (F.col("macro") == macro))
    return (found if config is None else found.where(F.col("config") == config)).orderBy("file", "line", "config")


def definitions(macros: DataFrame, file: str, name: str) -> DataFrame:
    """Every definition of a macro in a file, by line."""
    return macros.where((F.col("def_file") == file) & (F.col("name") == name)).orderBy("def_line")


def origin(position: Column, arguments: Column, body_lo: Column, body_hi: Column, verbatim: Column) -> Column:
    """Where a token comes from: an argument (array of struct lo, hi; an empty one is matched by its position), the body, the text as written, or nowhere."""
    in_arg = F.exists(arguments, lambda a: ((position >= a["lo"]) & (position < a["hi"])) | ((a["lo"] == a["hi"]) & (position == a["lo"])))
    return F.when(in_arg, "argument").when((position >= body_lo) & (position < body_hi), "body").when(verbatim, "verbatim").otherwise("synthesised")
