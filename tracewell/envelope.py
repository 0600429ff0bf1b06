"""What an answer is worth, carried beside the answer.

An Envelope wraps a DataFrame (never collected here) with a fidelity and the reasons for it. Fidelity can
only fall: a proof is what stays `exact` to the end, and an empty answer that isn't exact proves nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import IntEnum
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Fidelity(IntEnum):
    """Best first; the worst of several is their maximum."""

    exact = 0
    bounded = 1
    approximated = 2
    unknown = 3


def worst(*found: Fidelity) -> Fidelity:
    return max(found, default=Fidelity.exact)


@dataclass(frozen=True)
class Truncation:
    total: int
    shown: int
    cursor: int | None


@dataclass(frozen=True)
class Envelope:
    """result with its fidelity, the assumptions it rests on, what it can't see, and what was left out."""

    operation: str
    result: DataFrame
    fidelity: Fidelity = Fidelity.exact
    assumptions: tuple[str, ...] = ()
    blind_spots: tuple[str, ...] = ()
    truncation: Truncation | None = None
    nondeterministic_abort: bool = False
    notes: dict[str, Any] = field(default_factory=dict)

    @property
    def proven(self) -> bool:
        return self.fidelity is Fidelity.exact and not self.truncation and not self.nondeterministic_abort

    def downgrade(self, to: Fidelity, because: str | None = None) -> Envelope:
        """At most as good as `to`, with the reason kept once."""
        reasons = self.assumptions if because is None or because in self.assumptions else (*self.assumptions, because)
        return replace(self, fidelity=worst(self.fidelity, to), assumptions=reasons)

    def unseen(self, *spots: str) -> Envelope:
        return replace(self, blind_spots=tuple(dict.fromkeys((*self.blind_spots, *spots))))

    def truncated(self, total: int, shown: int, cursor: int | None) -> Envelope:
        if shown >= total:
            return self
        return replace(self.downgrade(Fidelity.bounded), truncation=Truncation(total, shown, cursor))

    def aborted(self, budget: str) -> Envelope:
        """A clock, not a count, ended the work: the answer may differ when run again."""
        return replace(self.downgrade(Fidelity.unknown, f"stopped by {budget}"), nondeterministic_abort=True)

    def body(self) -> DataFrame:
        """One JSON text per row, with fields in the order of the columns."""
        return self.result.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in self.result.columns)), {"ignoreNullFields": "false"}).alias("json"))

    def key(self) -> DataFrame:
        """determinism_key: one digest of the rows and the qualification, whatever order the rows arrive in."""
        about = f"{self.operation}|{self.fidelity.name}|{'|'.join(self.assumptions)}|{self.truncation}"
        return determinism_key(self.result, about)

    def head(self) -> dict[str, Any]:
        return {
            "operation": self.operation, "fidelity": self.fidelity.name, "proven": self.proven, "assumptions": list(self.assumptions), "blind_spots": list(self.blind_spots),
            "truncation": None if self.truncation is None else vars(self.truncation), "nondeterministic_abort": self.nondeterministic_abort, **self.notes,
        }

    def text(self, rows: int | None = 20) -> str:
        """For people: the first rows (all if rows is None), and always the qualification, in which rows left out here count."""
        found = self.result.toLocalIterator() if rows is None else self.result.limit(rows + 1).collect()
        shown = [" | ".join(f"{c}={r[c]}" for c in self.result.columns) for r in found]
        if rows is not None and len(shown) > rows:
            cut = self.truncated(self.truncation.total if self.truncation else self.result.count(), rows, None)
            return cut._said(shown[:rows])
        return self._said(shown)

    def _said(self, shown: list[str]) -> str:
        lines = [f"{self.operation}: {self.fidelity.name}{', proven' if self.proven else ''}", *(f"  {x}" for x in shown or ["(nothing)"])]
        lines += [f"  assuming {a}" for a in self.assumptions] + [f"  not seen: {b}" for b in self.blind_spots]
        if self.truncation:
            lines.append(f"  {self.truncation.shown} of {self.truncation.total} shown")
        return "\n".join(lines)


def determinism_key(rows: DataFrame, about: str = "") -> DataFrame:
    """A one-row table with a digest of all rows.

    Each row's SHA-256 gives four 60-bit numbers that are added up, so the aggregation is partial, needs no order and
    no task ever holds all rows; the sums and the count are hashed again.
    """
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(4)]
    sums = rows.agg(F.count("*").alias("n"), *parts)
    return sums.select(F.sha2(F.concat_ws("|", F.lit(about), "n", *(F.coalesce(F.col(f"p{k}"), F.lit(0).cast("decimal(38,0)")).cast("string") for k in range(4))), 256).alias("determinism_key"), F.col("n").alias("n_rows"))
