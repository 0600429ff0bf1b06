"""Record layout: padding, holes, cache-line straddles, placement of hot fields.

member is (tag, ord, name, offset, size); record is (tag, size, align, packed, fields_complete, internal).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.facts import align_up, next_power_of_two


def effective_members(fields: DataFrame) -> DataFrame:
    """Members that own whole bytes: each run of consecutive bit-fields is one, over the bytes that it touches.

    fields adds bit_offset and bit_width (null for ordinary ones); zero-width bit-fields are left out, but end no run.
    """
    real = fields.where("bit_width is null or bit_width > 0")
    w = Window.partitionBy("tag").orderBy("ord")
    bit = F.col("bit_width").isNotNull()
    run = real.withColumn("bit", bit).withColumn("starts", (bit & ~F.coalesce(F.lag("bit").over(w), F.lit(False))) | ~bit)
    run = run.withColumn("run", F.sum(F.col("starts").cast("int")).over(w))
    first = F.col("offset") + F.floor(F.coalesce("bit_offset", F.lit(0)) / 8)
    end = F.when(F.col("bit"), F.col("offset") + F.floor((F.col("bit_offset") + F.col("bit_width") - 1) / 8) + 1).otherwise(F.col("offset") + F.col("size"))
    return run.groupBy("tag", "run").agg(F.min("ord").alias("ord"), F.min_by("name", "ord").alias("name"), F.min(first).cast("long").alias("offset"), (F.max(end) - F.min(first)).cast("long").alias("size")).drop("run")


def holes(members: DataFrame, records: DataFrame) -> DataFrame:
    """tag, after, before (null at the end), bytes of each gap.

    A gap comes after the member that ends where it starts; the largest such member if there are several.
    """
    up = Window.partitionBy("tag").orderBy("offset", "size", "ord").rowsBetween(Window.unboundedPreceding, -1)
    m = members.withColumn("end", F.col("offset") + F.col("size"))
    inner = m.withColumn("at", F.max("end").over(up)).where("at is not null and offset > at").select("tag", "at", F.col("name").alias("before"), F.col("offset").alias("to"))
    last = m.groupBy("tag").agg(F.max("end").alias("at")).join(records.select("tag", F.col("size").alias("to")), "tag").where("to > at").select("tag", "at", F.lit(None).cast("string").alias("before"), "to")
    ends = m.groupBy("tag", F.col("end").alias("at")).agg(F.max_by("name", F.struct("size", "offset")).alias("after"))
    return inner.unionByName(last).join(ends, ["tag", "at"]).select("tag", "after", "before", (F.col("to") - F.col("at")).alias("bytes"))


def repacked_size(sizes: Column, align: Column) -> Column:
    """Size of a record with its members by descending size, each aligned to its power of two, at most the record's alignment."""
    place = lambda at, s: (align_up(at, F.greatest(F.least(next_power_of_two(s), align), F.lit(1))) + s).cast("long")
    end = F.aggregate(F.sort_array(sizes, asc=False), F.lit(0).cast("long"), place)
    return align_up(end, F.greatest(align, F.lit(1)))


def padding(members: DataFrame, records: DataFrame) -> DataFrame:
    """tag, size, packed_size, recoverable where reordering members saves bytes; not for packed or incompletely known records."""
    sizes = members.groupBy("tag").agg(F.collect_list("size").alias("sizes"))
    r = records.where("not packed and fields_complete").join(sizes, "tag").withColumn("packed_size", repacked_size(F.col("sizes"), F.col("align")))
    return r.select("tag", "size", "packed_size", (F.col("size") - F.col("packed_size")).alias("recoverable")).where("recoverable > 0")


def straddles(members: DataFrame, line: int = 64) -> DataFrame:
    """tag, name, boundary: members that cross a cache line though they would fit in one."""
    first, last = F.floor(F.col("offset") / line), F.floor((F.col("offset") + F.col("size") - 1) / line)
    return members.where((F.col("size") > 0) & (F.col("size") <= line) & (first != last)).select("tag", "name", (last * line).alias("boundary"))


def hot_fields(members: DataFrame, accesses: DataFrame, line: int = 64) -> DataFrame:
    """tag, name, accesses of the most accessed members that lie beyond the first cache line; nothing without counts."""
    most = accesses.groupBy("tag").agg(F.max("accesses").alias("most"))
    return members.join(accesses, ["tag", "name"]).join(most, "tag").where((F.col("accesses") == F.col("most")) & (F.col("offset") >= line) & (F.col("most") > 0)).select("tag", "name", "accesses")


def escapes() -> Column:
    """Of a record: why its layout may be observed from outside; null if it can't."""
    return F.when(F.col("packed"), "packed").when(~F.coalesce("internal", F.lit(False)), "not shown internal")


def proposals(members: DataFrame, records: DataFrame, accesses: DataFrame | None = None, line: int = 64) -> DataFrame:
    """tag, kind, name, amount, benefit, obligation, advisory; by kind, then name."""
    kind = lambda d, k, name, amount: d.select("tag", F.lit(k).alias("kind"), name.alias("name"), amount.cast("long").alias("amount"))
    none = F.lit(None).cast("string")
    all_ = kind(padding(members, records), "PaddingWaste", none, F.col("recoverable")).unionByName(kind(straddles(members, line), "Straddle", F.col("name"), F.col("boundary")))
    if accesses is not None:
        all_ = all_.unionByName(kind(hot_fields(members, accesses, line), "HotPlacement", F.col("name"), F.col("accesses")))
        measured = accesses.select("tag", "name", F.lit(True).alias("m"))
        all_ = all_.join(measured, ["tag", "name"], "left")
    else:
        all_ = all_.withColumn("m", F.lit(None).cast("boolean"))
    out = all_.join(records.select("tag", escapes().alias("obligation")), "tag", "left")
    rank = F.when(F.col("kind") == "PaddingWaste", 0).when(F.col("kind") == "Straddle", 1).otherwise(2)
    return out.select("tag", "kind", "name", "amount", F.when(F.col("m"), "Measured").otherwise("Unquantified").alias("benefit"), "obligation", F.col("obligation").isNotNull().alias("advisory")).orderBy("tag", rank, F.col("name").asc_nulls_first())
