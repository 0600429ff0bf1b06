"""Paths and globs: patterns are compiled on the driver, columns use SQL functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str:
    """Anchored: `**/` is any number of directories, `*` and `?` stay within one, all else is literal."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return f"^{out}$"


def glob_match(path: Column, glob: str) -> Column:
    return path.rlike(glob_to_regex(glob))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def same_file(a: Column, b: Column) -> Column:
    """Equal paths, or one is a bare name that is the other's last part."""
    bare = lambda x: ~F.contains(x, F.lit("/"))
    return (a == b) | ((bare(a) | bare(b)) & (basename(a) == basename(b)))


def normalized(path: Column, keep_parents: bool = False) -> Column:
    """The path without `.` and empty parts, and without `x/..` unless parents are kept as written."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    if not keep_parents:
        parts = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    root = F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(root, F.array_join(parts, "/"))
    return F.when((joined == "") & (path != ""), F.lit(".")).otherwise(joined)


def stripped(path: Column, count: int) -> Column:
    """The path without its first `count` directories; the last part always stays."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.array_join(F.slice(parts, F.least(F.lit(count), F.size(parts) - 1) + 1, F.size(parts)), "/")


def rerooted(path: Column, count: int, prefix: str) -> Column:
    """An absolute path below another root; a relative one is left alone."""
    return F.when(path.startswith("/"), F.concat_ws("/", F.lit(prefix.rstrip("/")), stripped(path, count))).otherwise(path)


def is_under(path: Column, directories: list[str]) -> Column:
    """Whether the path lies below one of the directories, part by part."""
    found = F.lit(False)
    for d in directories:
        found = found | path.startswith(f"{d.rstrip('/')}/")
    return found
