"""Recipes: named scopes over functions, with predicates that may be undecidable.

A predicate is a three-valued column: null means that only a typed syntax tree could tell, which is counted apart from false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.paths import glob_to_regex

#: Selectors that need a typed syntax tree.
TYPED = ("registered_via", "has_attribute", "signature", "calls")
SELECTORS = ("name matches", "in_file", *TYPED)


class RecipeError(ValueError):
    pass


@dataclass
class Recipe:
    name: str
    scope: list[tuple[str, str]] = field(default_factory=list)
    good: list[str] = field(default_factory=list)
    bad: list[tuple[str, str]] = field(default_factory=list)
    text: dict[str, str] = field(default_factory=dict)


def parse_recipe(text: str) -> Recipe:
    """A recipe from lines of `recipe NAME`, `scope SELECTOR "ARG"`, `fixture good "FILE"`, `fixture bad "FILE" at "PLACE"` and free `key: text`."""
    found: Recipe | None = None
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue

        def fail(why: str, at: int = number) -> RecipeError:
            return RecipeError(f"line {at}: {why}")

        word, _, rest = line.partition(" ")
        rest = rest.strip()
        if word == "recipe":
            if found:
                raise fail("a second recipe")
            found = Recipe(rest.strip('"'))
        elif found is None:
            raise fail("no recipe yet")
        elif word == "scope":
            kind = next((s for s in SELECTORS if rest == s or rest.startswith(f"{s} ")), None)
            if kind is None:
                raise fail(f"unknown selector {rest!r}")
            arg = rest[len(kind) :].strip().strip('"')
            if kind == "name matches":
                try:
                    re.compile(arg)
                except re.error as e:
                    raise fail(f"bad pattern: {e}") from e
            found.scope.append((kind, arg))
        elif word == "fixture":
            m = re.fullmatch(r'(good|bad)\s+"([^"]+)"(?:\s+at\s+"?([^"]+)"?)?', rest)
            if not m:
                raise fail("a fixture is good or bad, with a file")
            if m[1] == "good":
                found.good.append(m[2])
            elif m[3] is None:
                raise fail("a bad fixture says where")
            else:
                found.bad.append((m[2], m[3]))
        elif word.endswith(":"):
            found.text[word[:-1]] = rest
        else:
            raise fail(f"not understood: {line!r}")
    if found is None:
        raise RecipeError("no recipe")
    if not found.good or not found.bad:
        raise RecipeError(f"{found.name}: a recipe has a good and a bad fixture")
    return found


def in_scope(scope: list[tuple[str, str]], name: Column, file: Column) -> Column:
    """Whether all selectors hold: true, false, or null where that can't be decided."""
    out = F.lit(True)
    for kind, arg in scope:
        if kind == "name matches":
            out = out & name.rlike(arg)
        elif kind == "in_file":
            out = out & file.rlike(glob_to_regex(arg))
        elif kind in TYPED:
            out = out & F.lit(None).cast("boolean")
        else:
            raise RecipeError(f"unknown selector {kind!r}")
    return out


def tally(functions: DataFrame, recipes: list[tuple[str, list[tuple[str, str]]]]) -> DataFrame:
    """recipe_ix, recipe, matched, needs_ast in the order of the catalogue.

    All predicates are columns of one scan with one aggregate each, whatever the number of recipes.
    """
    tests = [in_scope(s, F.col("name"), F.col("file")) for _, s in recipes]
    aggs = [x for k, t in enumerate(tests) for x in (F.count_if(t).alias(f"m{k}"), F.count_if(t.isNull()).alias(f"n{k}"))]
    one = functions.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(k).alias("recipe_ix"), F.lit(n).alias("recipe"), F.col(f"m{k}").alias("matched"), F.col(f"n{k}").alias("needs_ast")) for k, (n, _) in enumerate(recipes)))
    return one.select(F.explode(rows).alias("r")).select("r.*").orderBy("recipe_ix")


def catalogue(spark: SparkSession, recipes: list[Recipe]) -> DataFrame:
    rows = [(k, r.name, s, a) for k, r in enumerate(recipes) for s, a in (r.scope or [(None, None)])]
    return spark.createDataFrame(rows, "ix int, name string, selector string, arg string")
