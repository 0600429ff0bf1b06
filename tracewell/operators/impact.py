"""What a source change reaches: classification of entities, widening, closure, completeness.

Entities are keyed by (kind, file, name) as text, since two parses share no ids. Gaps widen the result and are counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.facts import zip_positions
from tracewell.operators.fixpoint import written

KEY = ["kind", "file", "name"]
#: Kinds in the order of reports.
KINDS = ("Function", "Global", "Typedef", "Record", "EnumConst", "Macro")
EDGE_OF_KIND = {"Function": "Calls", "Global": "UsesGlobal", "EnumConst": "UsesGlobal", "Typedef": "UsesType", "Record": "UsesType", "Macro": "ExpandsMacro"}


def kind_rank(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(i)) for i, k in enumerate(KINDS)], F.lit(len(KINDS)))


def edge_label(kind: Column) -> Column:
    """What using an entity of this kind is called."""
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in EDGE_OF_KIND.items()])


def entity_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities of either side by KEY, with old and new (struct head, tail; null where absent) for classification."""
    side = lambda d, n: d.select(*KEY, F.struct("head", "tail").alias(n))
    return side(old, "old").join(side(new, "new"), KEY, "full_outer")


def token_class() -> Column:
    """Class of a change by tokens, from old and new of entity_diff; null if nothing changed."""
    o, n, head = F.col("old"), F.col("new"), ~F.col("old.head").eqNullSafe(F.col("new.head"))
    tail = ~F.col("old.tail").eqNullSafe(F.col("new.tail"))
    body = F.when(F.coalesce(F.get("new.tail", F.lit(0)), F.get("old.tail", F.lit(0))) == "{", "BodyChanged").otherwise("InitializerChanged")
    macro = F.when(head, "MacroInterfaceChanged").when(tail, "MacroBodyChanged")
    return F.when(o.isNull(), "Added").when(n.isNull(), "Removed").when(F.col("kind") == "Macro", macro).otherwise(F.when(head, "SignatureChanged").when(tail, body))


def record_changes(old_records: DataFrame, new_records: DataFrame, old_fields: DataFrame, new_fields: DataFrame) -> DataFrame:
    """tag, layout (whether size, alignment, union-ness or a common field's place changed), size_delta."""
    r = old_records.select("tag", F.struct("size", "align", "is_union").alias("o")).join(new_records.select("tag", F.struct("size", "align", "is_union").alias("n")), "tag")
    place = lambda d, n: d.select("tag", "name", F.struct("offset", "bit_offset", "bit_width").alias(n))
    moved = place(old_fields, "a").join(place(new_fields, "b"), ["tag", "name"]).groupBy("tag").agg(F.max(~F.col("a").eqNullSafe(F.col("b"))).alias("moved"))
    return r.join(moved, "tag", "left").select("tag", (~F.col("o").eqNullSafe(F.col("n")) | F.coalesce("moved", F.lit(False))).alias("layout"), (F.col("n.size") - F.col("o.size")).alias("size_delta"))


def classified(diff: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """KEY, class, size_delta of changed entities; records is record_changes() for entities of kind Record."""
    if records is None:
        return diff.select(*KEY, token_class().alias("class"), F.lit(None).cast("long").alias("size_delta")).where("class is not null")
    shaped = records.select(F.lit("Record").alias("kind"), F.col("tag").alias("name"), "layout", "size_delta")
    both = diff.join(shaped, ["kind", "name"], "left")
    differs = ~F.col("old").eqNullSafe(F.col("new"))
    known = F.when(F.col("layout"), "LayoutChanged").when(differs, "BodyChanged")
    there = F.col("layout").isNotNull() & F.col("old").isNotNull() & F.col("new").isNotNull()
    out = both.select(*KEY, F.when(there, known).otherwise(token_class()).alias("class"), F.when(there & F.col("layout"), F.col("size_delta")).alias("size_delta"))
    return out.where("class is not null")


def changed_conditions(old: DataFrame, new: DataFrame) -> DataFrame:
    """tu, pos, old, new of conditionals (tu, ord, directive, tokens) that differ by position in their unit, or that only one side has."""
    text = lambda d, n: d.select("tu", F.col("ord").alias("pos"), F.concat_ws(" ", F.col("directive"), F.array_join("tokens", " ")).alias(n))
    return text(old, "old").join(text(new, "new"), ["tu", "pos"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def zipped_conditions(pairs: DataFrame) -> DataFrame:
    """key, pos, old, new for rows (key, old array, new array), where they differ."""
    return pairs.select("key", F.explode(zip_positions(F.col("old"), F.col("new"))).alias("z")).where(~F.col("z.a").eqNullSafe(F.col("z.b"))).select("key", "z.pos", F.col("z.a").alias("old"), F.col("z.b").alias("new"))


def indirect_holders(changed: DataFrame, sites: DataFrame, arity: DataFrame, taken: DataFrame) -> DataFrame:
    """kind, file, name of holders of an indirect call that a changed address-taken function could answer.

    changed: entities; sites: (kind, file, name, args); arity: (name, params, variadic); taken: (name). A call of n
    arguments fits n parameters, or a variadic function of at most n.
    """
    via = F.min("distance" if "distance" in changed.columns else F.lit(0)).alias("via")
    could = changed.where("kind = 'Function'").join(taken, "name", "left_semi").groupBy("name").agg(via).join(arity.select("name", "params", "variadic"), "name")
    # Only the first callee of an arity can be a holder's, so each side is one row for each number before the two meet.
    first = could.groupBy("variadic", "params").agg(F.min(F.struct("via", F.col("name").alias("callee"))).alias("m"))
    # Equal arities are an equi-join; variadics are matched from each number of parameters up, by the distinct numbers of arguments.
    numbers = sites.select("args").distinct()
    fixed = first.where("not variadic").select(F.col("params").alias("args"), "m")
    loose = first.where("variadic").join(numbers, F.col("args") >= F.col("params")).select("args", "m")
    fits = fixed.unionByName(loose).groupBy("args").agg(F.min("m").alias("m"))
    return sites.join(fits, "args").groupBy(*KEY).agg(F.min("m").alias("m")).select(*KEY, F.col("m.callee").alias("callee"), (F.col("m.via") + 1).alias("distance"))


@dataclass(frozen=True)
class Completeness:
    """Whether the impact set can be relied on; every gap is counted."""

    unparsed_files: tuple[str, ...] = ()
    unresolved_calls: int = 0
    unknown_configs: tuple[str, ...] = ()
    address_taken_fallbacks: int = 0

    @property
    def complete(self) -> bool:
        return not (self.unparsed_files or self.unknown_configs or self.address_taken_fallbacks)


def completeness(gaps: DataFrame, by: list[str]) -> DataFrame:
    """by, state, gaps: Complete where nothing is amiss in (by, gap) with gap null for none."""
    return gaps.groupBy(*by).agg(F.count("gap").alias("gaps")).select(*by, F.when(F.col("gaps") == 0, "Complete").otherwise("Partial").alias("state"), "gaps")


def closure(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Breadth-first closure of changed entities over who mentions them.

    members: KEY, class, root, ord (report order), distance, path (array of edge labels). edges: KEY of the holder,
    the mentioned name, ord (old references, new references, old expansions, new expansions). A holder is matched by
    name only. It is placed once, by the first member of the frontier, in frontier order, that it mentions, and has that member's class and root,
    the new edge and then the member's edges without DirectlyChanged. A level's order is that of its holders, then report order.
    """
    hold = written(edges.groupBy(*KEY, "mentioned").agg(F.min("ord").alias("holder_ord")))
    placed = written(members.select(*KEY, "class", "root", F.col("ord").cast("long").alias("ord"), "distance", "path"))
    frontier = placed
    while True:
        front = frontier.select(F.col("name").alias("mentioned"), F.struct("ord", kind_rank(F.col("kind")).alias("rank"), F.col("file").alias("f"), F.col("name").alias("n"), F.col("kind").alias("k"), "class", "root", "distance", "path").alias("via"))
        ahead = hold.join(front, "mentioned").groupBy(*KEY).agg(F.min("via").alias("via"), F.min("holder_ord").alias("holder_ord"))
        own = F.filter("via.path", lambda x: x != "DirectlyChanged")
        level = ahead.join(placed.select(*KEY), KEY, "left_anti").select(*KEY, F.col("via.class").alias("class"), F.col("via.root").alias("root"), F.col("holder_ord").cast("long").alias("ord"), (F.col("via.distance") + 1).alias("distance"), F.concat(F.array(edge_label(F.col("via.k"))), own).alias("path"))
        level = written(level)
        if level.isEmpty():
            return placed
        placed, frontier = written(placed.unionByName(level)), level


def impact(changed: DataFrame, edges: DataFrame, entities: DataFrame | None = None, unclean: DataFrame | None = None, conditions_changed: bool = False, indirect: DataFrame | None = None) -> DataFrame:
    """The impact set: changed entities (KEY, class, size_delta), widened, then closed over edges.

    unclean: files (file) that a side failed to parse: all their entities become Unknown. indirect: indirect_holders().
    conditions_changed: a conditional's text changed, so every entity may be configured otherwise.
    """
    first = changed.select(*KEY, "class", "size_delta", F.lit("DirectlyChanged").alias("edge"), F.lit(0).alias("distance"))
    if unclean is not None and entities is not None:
        more = entities.select(*KEY).distinct().join(unclean, "file", "left_semi").join(first.select(*KEY), KEY, "left_anti")
        first = first.unionByName(more.select(*KEY, F.lit("Unknown").alias("class"), F.lit(None).cast("long").alias("size_delta"), F.lit("DirectlyChanged").alias("edge"), F.lit(0).alias("distance")))
    if indirect is not None:
        more = indirect.join(first.select(*KEY), KEY, "left_anti")
        first = first.unionByName(more.select(*KEY, F.lit("BodyChanged").alias("class"), F.lit(None).cast("long").alias("size_delta"), F.lit("IndirectCall").alias("edge"), "distance"))
    if conditions_changed and entities is not None:
        more = entities.select(*KEY).distinct().join(first.select(*KEY), KEY, "left_anti")
        first = first.unionByName(more.select(*KEY, F.lit("ConfigChanged").alias("class"), F.lit(None).cast("long").alias("size_delta"), F.lit("DirectlyChanged").alias("edge"), F.lit(0).alias("distance")))
    first = written(first)
    members = first.select(*KEY, "class", F.struct(*KEY).alias("root"), F.lit(0).cast("long").alias("ord"), "distance", F.array("edge").alias("path"))
    found = closure(members, edges)
    return found.join(first.select(*KEY, "size_delta"), KEY, "left").select(*KEY, "class", "size_delta", "root", "path", "distance")


def in_report_order(found: DataFrame) -> DataFrame:
    return found.orderBy(kind_rank(F.col("kind")), "file", "name")
