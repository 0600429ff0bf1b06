"""C string and character literals: prefix, escapes and code units.

Units are of 1 byte without a prefix or with u8 (UTF-8), of 2 with u (UTF-16), of 4 with U or L. An octal escape has up to
three digits, a hexadecimal one all that follow; both are units as they stand, cut to the unit's width and flagged if they
don't fit. \\u and \\U are code points. A literal without its closing quote, an unknown escape or a code point that isn't a
character is an error, and has no units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

BYTES = {"": 1, "u8": 1, "u": 2, "U": 4, "L": 4}
#: The simple escapes of C, and \e as compilers take it.
SIMPLE = {"n": 10, "t": 9, "r": 13, "a": 7, "b": 8, "f": 12, "v": 11, "e": 27, "\\": 92, "'": 39, '"': 34, "?": 63}

_LITERAL = re.compile(r"""(u8|u|U|L)?(["'])(.*)\2""", re.DOTALL)
_PART = re.compile(r"\\(?:(?P<octal>[0-7]{1,3})|x(?P<hex>[0-9A-Fa-f]+)|u(?P<short>[0-9A-Fa-f]{4})|U(?P<long>[0-9A-Fa-f]{8})|(?P<simple>[^xuU0-7\n]))|(?P<plain>[^\\\n]+)")
_CODEC = {1: "utf-8", 2: "utf-16-le", 4: "utf-32-le"}


def decoded(literal: str) -> tuple[int, list[int], bool, str | None]:
    """(bytes of a unit, units without the final 0, whether an escape was cut, the error)."""
    m = _LITERAL.fullmatch(literal)
    if not m:
        return 0, [], False, "unterminated"
    size = BYTES[m[1] or ""]
    units, cut, at, body = [], False, 0, m[3]
    while at < len(body):
        p = _PART.match(body, at)
        if not p or p["plain"] and m[2] in p["plain"]:
            return size, [], False, "escape" if body[at] == "\\" else "unterminated"
        at = p.end()
        raw = p["octal"] or p["hex"]
        if raw:
            value = int(raw, 8 if p["octal"] else 16)
            cut |= value >= 1 << 8 * size
            units.append(value % (1 << 8 * size))
            continue
        if p["simple"]:
            if p["simple"] not in SIMPLE:
                return size, [], False, "escape"
            units.append(SIMPLE[p["simple"]])
            continue
        point = p["short"] or p["long"]
        if point and (int(point, 16) > 0x10FFFF or 0xD800 <= int(point, 16) < 0xE000):
            return size, [], False, "code point"
        b = (chr(int(point, 16)) if point else p["plain"]).encode(_CODEC[size], "surrogatepass")
        units += [int.from_bytes(b[i : i + size], "little") for i in range(0, len(b), size)]
    return size, units, cut, None


#: As a type, not as text: text is parsed by a session, and there may be none yet.
UNITS = StructType().add("unit_bytes", IntegerType()).add("units", ArrayType(LongType())).add("cut", BooleanType()).add("error", StringType())


@F.pandas_udf(UNITS)
def literal_units(literals: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """decoded() of a column; a null literal is an error of its own."""
    for s in literals:
        yield pd.DataFrame([(0, [], False, "null") if x is None else decoded(x) for x in s], columns=["unit_bytes", "units", "cut", "error"])
