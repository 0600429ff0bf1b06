"""Column functions that keep unknown, recorded zero and recorded non-zero apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest unsigned 64-bit count.
U64_MAX = 18446744073709551615
COUNT = "decimal(20,0)"


def largest() -> Column:
    return F.lit(str(U64_MAX)).cast("decimal(38,0)")


def saturating_sum(count: Column | str) -> Column:
    """Sum of unsigned 64-bit counts that stays at the largest one; null if there is none."""
    c = F.col(count) if isinstance(count, str) else count
    total = F.sum(c.cast("decimal(38,0)"))
    return F.when(total.isNotNull(), F.least(total, largest())).cast(COUNT)  # least() alone would skip a null


def saturating_add(a: Column, b: Column) -> Column:
    total = a.cast("decimal(38,0)") + b.cast("decimal(38,0)")
    return F.when(total.isNotNull(), F.least(total, largest())).cast(COUNT)


def recorded_set(recorded: Column, value: Column) -> Column:
    """Aggregate: null if nothing was recorded, else the sorted distinct values where there are some, [] if none."""
    return F.when(F.max(F.coalesce(recorded, F.lit(False))), F.sort_array(F.collect_set(value)))


def union_sets(arrays: Column) -> Column:
    """Aggregate over arrays of which null means unrecorded: null only if all are; else the sorted distinct union."""
    return F.when(F.max(arrays.isNotNull()), F.sort_array(F.array_distinct(F.flatten(F.collect_list(arrays)))))


def zip_positions(a: Column, b: Column) -> Column:
    """Array of (pos, a, b) by position; the shorter one's missing places are null and marked absent."""
    pair = F.arrays_zip(a.alias("a"), b.alias("b"))
    return F.transform(pair, lambda x, i: F.struct(i.alias("pos"), x["a"].alias("a"), x["b"].alias("b"), (i < F.size(a)).alias("in_a"), (i < F.size(b)).alias("in_b")))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: (i < F.least(F.size(a), F.size(b))) & x["a"].eqNullSafe(x["b"]))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def common_suffix(a: Column, b: Column) -> Column:
    """How many trailing elements they share beyond the common prefix."""
    return F.least(common_prefix(F.reverse(a), F.reverse(b)), F.least(F.size(a), F.size(b)) - common_prefix(a, b))


def next_power_of_two(x: Column) -> Column:
    return F.when(x <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(x.cast("double"))))).cast("long")


def align_up(offset: Column, align: Column) -> Column:
    return (F.floor((offset + align - 1) / align) * align).cast("long")
