"""What is known of a fixed-width value without a solver: an unsigned interval and known bits, as one struct column.

A domain is (lo, hi, zeros, ones): lo <= value <= hi, and the bits of the two masks are known. Widths up to 32 bits, held in
longs. Each operation keeps every value that can occur; it may keep more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(f: Callable[..., Column], *given: Column) -> Column:
    """f of the given columns, each evaluated once however often f mentions it, so that expressions don't grow when nested."""
    bound = lambda x: f(*(x[f"v{k}"] for k in range(len(given))))
    return F.element_at(F.transform(F.array(F.struct(*(c.alias(f"v{k}") for k, c in enumerate(given)))), bound), 1)


def _mask(width: int) -> Column:
    return F.lit((1 << width) - 1).cast("long")


def _domain(lo: Column, hi: Column, zeros: Column, ones: Column) -> Column:
    return F.struct(*(c.cast("long").alias(n) for c, n in ((lo, "lo"), (hi, "hi"), (zeros, "zeros"), (ones, "ones"))))


def top(width: int) -> Column:
    """Nothing is known."""
    return _domain(F.lit(0), _mask(width), F.lit(0), F.lit(0))


def constant(x: Column, width: int) -> Column:
    """One value, taken modulo the width."""
    low = x.bitwiseAND(_mask(width))
    return _domain(low, low, F.bitwise_not(low).bitwiseAND(_mask(width)), low)


def between(lo: Column, hi: Column, width: int) -> Column:
    return reduced(_domain(lo, hi, F.lit(0), F.lit(0)), width)


def empty(x: Column) -> Column:
    """Whether no value is left."""
    return (x["lo"] > x["hi"]) | (x["zeros"].bitwiseAND(x["ones"]) != 0)


def admits(x: Column, value: Column, width: int) -> Column:
    return value.between(x["lo"], x["hi"]) & (value.bitwiseAND(x["zeros"]) == 0) & (F.bitwise_not(value).bitwiseAND(x["ones"]) == 0)


def reduced(x: Column, width: int) -> Column:
    """Bounds tightened by the known bits, and the leading bits on which the bounds agree made known."""
    def tight(lo: Column, hi: Column, zeros: Column, ones: Column) -> Column:
        differ = F.when(lo == hi, F.lit(0)).otherwise(F.length(F.bin(lo.bitwiseXOR(hi))))  # bits below the first that differs, and it
        same = F.when(lo <= hi, _mask(width) - F.pow(F.lit(2.0), differ).cast("long") + 1).otherwise(F.lit(0))
        return _let(lambda lo, k, z, o, hi: _domain(lo, hi, z.bitwiseOR(F.bitwise_not(lo).bitwiseAND(k)), o.bitwiseOR(lo.bitwiseAND(k))), lo, same, zeros, ones, hi)

    bounds = lambda x: _let(tight, F.greatest(x["lo"], x["ones"]), F.least(x["hi"], F.bitwise_not(x["zeros"]).bitwiseAND(_mask(width))), x["zeros"], x["ones"])
    return _let(bounds, x)


def meet(x: Column, y: Column, width: int) -> Column:
    """What both allow."""
    both = lambda x, y: _domain(F.greatest(x["lo"], y["lo"]), F.least(x["hi"], y["hi"]), x["zeros"].bitwiseOR(y["zeros"]), x["ones"].bitwiseOR(y["ones"]))
    return reduced(_let(both, x, y), width)


def join(x: Column, y: Column, width: int) -> Column:
    """What either allows."""
    return _let(lambda x, y: _domain(F.least(x["lo"], y["lo"]), F.greatest(x["hi"], y["hi"]), x["zeros"].bitwiseAND(y["zeros"]), x["ones"].bitwiseAND(y["ones"])), x, y)


def _of_bits(zeros: Column, ones: Column, width: int) -> Column:
    return _domain(ones, F.bitwise_not(zeros).bitwiseAND(_mask(width)), zeros, ones)


def _of_bounds(lo: Column, hi: Column, width: int) -> Column:
    """An interval if both bounds wrap equally often, else nothing known."""
    turn = lambda v: F.shiftright(v, width)
    kept = turn(lo) == turn(hi)
    return _domain(F.when(kept, lo.bitwiseAND(_mask(width))).otherwise(F.lit(0)), F.when(kept, hi.bitwiseAND(_mask(width))).otherwise(_mask(width)), F.lit(0), F.lit(0))


def _and(x: Column, y: Column, w: int) -> Column:
    return _of_bits(x["zeros"].bitwiseOR(y["zeros"]), x["ones"].bitwiseAND(y["ones"]), w)


def _or(x: Column, y: Column, w: int) -> Column:
    return _of_bits(x["zeros"].bitwiseAND(y["zeros"]), x["ones"].bitwiseOR(y["ones"]), w)


def _xor(x: Column, y: Column, w: int) -> Column:
    both = x["zeros"].bitwiseAND(y["zeros"]).bitwiseOR(x["ones"].bitwiseAND(y["ones"]))
    either = x["zeros"].bitwiseAND(y["ones"]).bitwiseOR(x["ones"].bitwiseAND(y["zeros"]))
    return _of_bits(both, either, w)


def _add(x: Column, y: Column, w: int) -> Column:
    return _of_bounds(x["lo"] + y["lo"], x["hi"] + y["hi"], w)


def _sub(x: Column, y: Column, w: int) -> Column:
    return _of_bounds(x["lo"] - y["hi"], x["hi"] - y["lo"], w)


def _named(f: Callable[[Column, Column, int], Column]) -> Callable[[Column, Column, int], Column]:
    return lambda x, y, w: _let(lambda x, y: f(x, y, w), x, y)


#: Binary operations by name, each (domain, domain, width) -> domain.
BINARY = {"Add": _named(_add), "Sub": _named(_sub), "And": _named(_and), "Or": _named(_or), "Xor": _named(_xor)}


def complement(x: Column, width: int) -> Column:
    return _let(lambda x: _domain(_mask(width) - x["hi"], _mask(width) - x["lo"], x["ones"], x["zeros"]), x)
