"""Fixed-width integers as column expressions: the operators of an intermediate language, total as in SMT-LIB.

A value of width w (1 to 64) is held as BIGINT in its signed reading. Arithmetic wraps. Division by zero gives all
ones for unsigned, -1 or 1 by the dividend's sign for signed, and the dividend as remainder; a shift by the width or more gives 0, or the sign.
Floating comparisons come ordered and unordered, where Spark's own take NaN for equal to itself and largest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def _wide(x: Column) -> Column:
    return x.cast(WIDE)


def truncated(x: Column, width: int) -> Column:
    """The low bits of a BIGINT, in their signed reading."""
    return x if width == 64 else F.shiftright(F.shiftleft(x, 64 - width), 64 - width)


def _wrapped(x: Column, width: int) -> Column:
    """The low bits of an integer of up to 37 digits, in their signed reading."""
    m = F.pmod(x, F.lit(str(1 << width)).cast(WIDE))
    return F.when(m >= F.lit(str(1 << (width - 1))).cast(WIDE), m - F.lit(str(1 << width)).cast(WIDE)).otherwise(m).cast("long")


def unsigned(x: Column, width: int) -> Column:
    """The unsigned reading, as a decimal."""
    return F.when(x < 0, _wide(x) + F.lit(str(1 << width)).cast(WIDE)).otherwise(_wide(x)).cast(WIDE)


def _quotient(a: Column, b: Column) -> Column:
    """a / b towards zero for whole decimals; b isn't zero."""
    b = F.when(b == 0, F.lit(1).cast(WIDE)).otherwise(b)
    return ((a - a % b) / b).cast(WIDE)


def _shift(name: str, x: Column, by: Column) -> Column:
    return F.call_function(name, x, by.cast("int"))


def _shl(a: Column, b: Column, w: int) -> Column:
    return F.when((b < 0) | (b >= w), F.lit(0).cast("long")).otherwise(truncated(_shift("shiftleft", a, b), w))


def _lshr(a: Column, b: Column, w: int) -> Column:
    low = a if w == 64 else a.bitwiseAND(F.lit((1 << w) - 1))
    return F.when((b < 0) | (b >= w), F.lit(0).cast("long")).otherwise(truncated(_shift("shiftrightunsigned", low, b), w))


def _ashr(a: Column, b: Column, w: int) -> Column:
    return F.when((b < 0) | (b >= w), F.when(a < 0, -1).otherwise(0).cast("long")).otherwise(_shift("shiftright", a, b))


BINARY = {
    "Add": lambda a, b, w: _wrapped(_wide(a) + _wide(b), w),
    "Sub": lambda a, b, w: _wrapped(_wide(a) - _wide(b), w),
    "Mul": lambda a, b, w: _wrapped((_wide(a) * _wide(b)).cast(WIDE), w),
    "UDiv": lambda a, b, w: F.when(b == 0, F.lit(-1).cast("long")).otherwise(_wrapped(_quotient(unsigned(a, w), unsigned(b, w)), w)),
    "SDiv": lambda a, b, w: F.when(b == 0, F.when(a < 0, 1 if w > 1 else -1).otherwise(-1).cast("long")).otherwise(_wrapped(_quotient(_wide(a), _wide(b)), w)),
    "URem": lambda a, b, w: F.when(b == 0, a).otherwise(_wrapped(unsigned(a, w) % F.when(b == 0, F.lit(1).cast(WIDE)).otherwise(unsigned(b, w)), w)),
    "SRem": lambda a, b, w: F.when(b == 0, a).otherwise(_wrapped(_wide(a) % F.when(b == 0, F.lit(1).cast(WIDE)).otherwise(_wide(b)), w)),
    "And": lambda a, b, w: a.bitwiseAND(b),
    "Or": lambda a, b, w: a.bitwiseOR(b),
    "Xor": lambda a, b, w: a.bitwiseXOR(b),
    "Shl": _shl,
    "LShr": _lshr,
    "AShr": _ashr,
}
FLOAT_BINARY = {
    "FAdd": lambda a, b: a + b,
    "FSub": lambda a, b: a - b,
    "FMul": lambda a, b: a * b,
    "FDiv": lambda a, b: F.when(b != 0, F.try_divide(a, b)).when(F.isnan(a) | F.isnan(b) | (a == 0), F.lit(float("nan"))).otherwise(F.when((a > 0) == (F.lit(1.0) * b >= 0) & ~b.cast("string").startswith("-"), float("inf")).otherwise(float("-inf"))),
    "FRem": lambda a, b: F.when(b != 0, a % F.when(b != 0, b).otherwise(1.0)).otherwise(float("nan")),
}


def pointer_difference(a: Column, b: Column, element: int) -> Column:
    """The distance of two addresses of 64 bits, in elements."""
    return _quotient(_wide(BINARY["Sub"](a, b, 64)), F.lit(element).cast(WIDE)).cast("long")


UNARY = {"Neg": lambda a, w: _wrapped(-_wide(a), w), "Not": lambda a, w: F.bitwise_not(a)}
FLOAT_UNARY = {"FNeg": lambda a: -a}

_less = {"Lt": lambda a, b: a < b, "Le": lambda a, b: a <= b, "Gt": lambda a, b: a > b, "Ge": lambda a, b: a >= b}
COMPARE = {"Eq": lambda a, b, w: a == b, "Ne": lambda a, b, w: a != b}
COMPARE |= {f"S{n}": lambda a, b, w, f=f: f(a, b) for n, f in _less.items()}
COMPARE |= {f"U{n}": lambda a, b, w, f=f: f(unsigned(a, w), unsigned(b, w)) for n, f in _less.items()}


def _ordered(a: Column, b: Column) -> Column:
    return ~(F.isnan(a) | F.isnan(b))


_float = {"Eq": lambda a, b: a == b, "Ne": lambda a, b: a != b, **_less}
FLOAT_COMPARE = {f"FO{n}": lambda a, b, f=f: _ordered(a, b) & f(a, b) for n, f in _float.items()} | {f"FU{n}": lambda a, b, f=f: ~_ordered(a, b) | f(a, b) for n, f in _float.items() if n in ("Eq", "Ne")}
FLOAT_COMPARE |= {"FOrd": _ordered, "FUno": lambda a, b: ~_ordered(a, b)}

CAST = {
    "Trunc": lambda a, w, to: truncated(a, to),
    "ZExt": lambda a, w, to: _wrapped(unsigned(a, w), to),
    "SExt": lambda a, w, to: a,
    "FpTrunc": lambda a, w, to: a.cast("float"),
    "FpExt": lambda a, w, to: a.cast("double"),
    "FpToSi": lambda a, w, to: F.when(~F.isnan(a) & (F.abs(a) < float(1 << (to - 1))), F.when(F.abs(a) < float(1 << 63), a).cast("long")),
    "FpToUi": lambda a, w, to: F.when(~F.isnan(a) & (a > -1) & (a < float(1 << to)), _wrapped(F.when(F.abs(a) < float(1 << to), a).cast(WIDE), to)),
    "SiToFp": lambda a, w, to: a.cast("double"),
    "UiToFp": lambda a, w, to: unsigned(a, w).cast("double"),
    "PtrToInt": lambda a, w, to: truncated(a, to),
    "IntToPtr": lambda a, w, to: _wrapped(unsigned(a, w), 64),
    "Bitcast": lambda a, w, to: a,
}


def overflows(op: str, a: Column, b: Column, width: int, signed: bool = True) -> Column:
    """Whether Add, Sub or Mul leaves the range of the width."""
    x, y = (_wide(a), _wide(b)) if signed else (unsigned(a, width), unsigned(b, width))
    r = {"Add": x + y, "Sub": x - y, "Mul": (x * y).cast(WIDE)}[op]
    lo, hi = (-(1 << (width - 1)), (1 << (width - 1)) - 1) if signed else (0, (1 << width) - 1)
    # A product beyond 37 digits is null; both operands are in range, so it left it.
    return F.coalesce((r < F.lit(str(lo)).cast(WIDE)) | (r > F.lit(str(hi)).cast(WIDE)), F.lit(True))


def popcount(a: Column, width: int) -> Column:
    return F.bit_count(a if width == 64 else a.bitwiseAND(F.lit((1 << width) - 1)))


def _low(a: Column, width: int) -> Column:
    return F.bin(a if width == 64 else a.bitwiseAND(F.lit((1 << width) - 1)))


def leading_zeros(a: Column, width: int) -> Column:
    """Null at 0, where it isn't defined."""
    return F.when(a != 0, F.lit(width) - F.length(_low(a, width)))


def trailing_zeros(a: Column, width: int) -> Column:
    text = _low(a, width)
    return F.when(a != 0, F.length(text) - F.length(F.rtrim(text, F.lit("0"))))


def byte_swapped(a: Column, width: int) -> Column:
    """The bytes in the other order; width is 16, 32 or 64."""
    out = F.lit(0).cast("long")
    for k in range(width // 8):
        byte = F.shiftrightunsigned(a, 8 * k).bitwiseAND(F.lit(255))
        out = out.bitwiseOR(F.shiftleft(byte.cast("long"), width - 8 - 8 * k))
    return truncated(out, width)
