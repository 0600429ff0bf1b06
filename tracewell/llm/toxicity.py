"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding maps each character to one of a small alphabet: letters lose case and marks, look-alikes of
other scripts and digits or signs used as letters become the letter they stand for, i and l share one
form, invisible characters vanish, everything else is a blank. Lexicon and text are folded alike.

The lexicon is learned from labelled documents: word beginnings of several lengths that toxic documents have far
more often than clean ones, with their log odds less a standard error as weights; the longest in a word counts, and a beginning found in the same
documents as a longer one is left to that. A term must follow many different words, so that copies of one toxic document don't put all of its words on the list. Exception phrases (given
ones, and neighbours learned from clean documents) cancel the terms they hold. Counting is done in tasks and added up. The sum of weights is divided by the
number of words and mapped to 0..1 so that the learned threshold is 0.5.

Defined results: null and empty texts sum to 0 and get the lowest score; texts are read whole;
repeated rows get equal scores; without labels of both kinds the lexicon is empty and nothing is toxic;
an empty table gives no rows; other columns are ignored. A doc_id labelled twice is learned once.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._spark import bounded, dropped, stored, table
from tracewell.llm.language_id import held_out

#: Labelled documents of each kind that the lexicon is learned from (chosen by a hash of the key), about.
TRAIN_DOCS = 4_000
#: Fewest and most letters of a term.
SHORTEST, LONGEST = 4, 8
#: A term is in at least so many toxic documents, after so many different words, with such log odds less one standard error.
MIN_DOCS, MIN_NEIGHBOURS, MIN_ODDS = 4, 4, 2.5
#: Size of the model: terms (the strongest) and learned phrases (the most frequent), letters of a phrase.
TERMS, PHRASE = 20_000, 64
#: Counts that a task holds before it passes them on.
ENTRIES = 200_000

#: Characters of other scripts that look like a Latin letter, and signs used as letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "i", "ɡ": "g",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ø": "o", "đ": "d", "ł": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "l": "i",
}


@functools.cache
def _table() -> np.ndarray:
    """The folded form of each code point: a letter a-z, a blank, 0 (to be left out), or a byte from 128 on for other letters."""
    out = np.full(0x110000, 32, dtype=np.uint8)
    for c in range(0x30000):
        x = chr(c)
        kind = unicodedata.category(x)
        if kind in ("Mn", "Cf"):
            out[c] = 0
            continue
        base = unicodedata.normalize("NFKD", x.lower())[:1] or x
        base = LOOKALIKES.get(base, LOOKALIKES.get(x, base))
        base = LOOKALIKES.get(base, base)
        if "a" <= base <= "z":
            out[c] = ord(base)
        elif kind[0] == "L":
            out[c] = 128 + c % 120
    return out


def fold(text: str | None) -> str:
    """One blank, the folded text, one blank."""
    c = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    f = _table()[c]
    return f[f != 0].tobytes().decode("latin-1")


def beginnings(word: str) -> list[str]:
    """The beginnings of a folded word that can be terms, shortest first."""
    return [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)]


class Lexicon:
    """Weighted terms and exception phrases, all folded; the automaton is built where it is used.

    Beginnings of one word add up, so a term holds what it adds to the terms it begins with: a word counts as its longest term.
    """

    def __init__(self, terms: dict[str, float], exceptions: dict[str, float], threshold: float):
        self.terms, self.exceptions, self.threshold = terms, exceptions, threshold
        self._automaton = None

    @classmethod
    def of(cls, odds: dict[str, float], phrases: set[str]) -> Lexicon:
        """From the log odds of beginnings and the folded phrases that cancel the terms they hold."""
        longest = lambda w: next((odds[x] for x in reversed(beginnings(w)) if x in odds), 0.0)
        terms = {f" {x}": w - longest(x[:-1]) for x, w in odds.items()}
        cancel = {p: -sum(map(longest, p.split())) for p in sorted(phrases)}
        return cls(terms, {p: w for p, w in cancel.items() if w and p not in terms}, 1.0)

    def __getstate__(self):
        return self.terms, self.exceptions, self.threshold

    def __setstate__(self, state):
        (self.terms, self.exceptions, self.threshold), self._automaton = state, None

    def weight(self, text: str | None) -> float:
        """Sum of the weights in the text over its number of words."""
        if not self.terms:
            return 0.0
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for x, w in {**self.terms, **self.exceptions}.items():
                self._automaton.add_word(x, w)
            self._automaton.make_automaton()
        folded = fold(text)
        total = sum(w for _, w in self._automaton.iter(folded))
        return total / max(1, len(folded.split())) if total > 0 else 0.0

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-min(50.0, 4 * (self.weight(text) / self.threshold - 1)))))


def _counted(docs: DataFrame, found: Callable[[str | None, bool], Iterable[tuple]]) -> DataFrame:
    """what found() yields of each (t, toxic) as (kind, x, toxic, n), counts added up within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: Counter = Counter()

        def flush() -> pa.RecordBatch:
            kinds, xs, toxic = zip(*have, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(xs), pa.array(toxic), pa.array([*have.values()], pa.int64())], ["kind", "x", "toxic", "n"])

        for b in batches:
            for t, bad in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                have.update(found(t.as_py(), bad))
                if len(have) > ENTRIES:
                    yield flush()
                    have.clear()
        if have:
            yield flush()

    return docs.select("t", "toxic").mapInArrow(run, "kind string, x string, toxic boolean, n long").groupBy("kind", "x", "toxic").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from labelled texts (t, y); counts and one weight a row reach the driver, texts don't."""
    rows = stored(rows.select("t", (F.col("y") == 1).alias("toxic")))
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        dropped(rows)
        return Lexicon({}, {}, 1.0)

    by = lambda kind: F.sum(F.when(F.col("toxic") == kind, F.col("n")).otherwise(0))
    docs = _counted(rows, lambda t, bad: {("term", x, bad) for w in fold(t).split() for x in beginnings(w)}).groupBy("x").agg(by(True).alias("a"), by(False).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n[True] + 1)) - F.log((F.col("b") + 0.5) / (n[False] + 1))
    odds -= F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))  # rare beginnings prove little
    some = docs.where(F.col("a") >= MIN_DOCS).select("x", "a", "b", odds.alias("w")).where(F.col("w") >= MIN_ODDS).orderBy(F.desc("w"), F.desc("a"), "x").limit(TERMS).collect()
    known = {r.x for r in some}

    def around(t: str | None, bad: bool) -> set[tuple]:
        words, out = ["", *fold(t).split()], set()
        for k, w in enumerate(words):
            terms = known.intersection(beginnings(w))
            if bad:
                out.update(("before", f"{x} {zlib.crc32(words[k - 1].encode())}", bad) for x in terms)
            if terms:
                out.update(("phrase", f" {' '.join(words[max(1, a) : a + 2])} ", bad) for a in (k - 1, k) if sum(map(len, words[max(1, a) : a + 2])) <= PHRASE)
        return out

    near = _counted(rows, around)
    before = near.where("kind = 'before'").select(F.substring_index("x", " ", 1).alias("x")).groupBy("x").count()
    before = {r.x: r["count"] for r in before.collect()}
    phrases = near.where("kind = 'phrase'").groupBy("x").agg(by(True).alias("a"), by(False).alias("b"))
    phrases = phrases.where((F.col("b") >= MIN_DOCS) & (F.col("a") * n[False] < F.col("b") * n[True] / 4)).orderBy(F.desc("b"), "x").limit(TERMS)
    clean = {r.x for r in phrases.select("x").collect()}
    terms = {r.x: r for r in some if before[r.x] >= max(MIN_NEIGHBOURS, min(r.a, 40) / 2)}
    # A beginning that one longer term accounts for says no more than that term.
    same = {x[:-1] for x, r in terms.items() if x[:-1] in terms and terms[x[:-1]][1:3] == r[1:3]}
    found = Lexicon.of({x: r.w for x, r in terms.items() if x not in same}, clean | {f"{fold(x).rstrip()} " for x in exceptions})

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([found.weight(t.as_py()) for t in b.column(0)], pa.float64())], ["toxic", "w"])

    each = rows.mapInArrow(weighed, "toxic boolean, w double").toPandas()
    dropped(rows)
    found.threshold = threshold(each["w"].to_numpy(), each["toxic"].to_numpy(dtype=bool))
    return found


def threshold(x: np.ndarray, toxic: np.ndarray) -> float:
    """The weight that separates best, both kinds counting alike."""
    order = np.argsort(x, kind="stable")
    wrong = np.concatenate(([0], np.cumsum(np.where(toxic[order], (~toxic).sum() / toxic.sum(), -1.0))))  # toxic below less clean below
    edges = np.concatenate((x[order][:1] - 1e-6, (x[order][1:] + x[order][:-1]) / 2, x[order][-1:] + 1e-6))
    wrong[1:-1][np.diff(x[order]) == 0] = np.inf
    return float(max(edges[int(np.argmin(wrong))], 1e-6))


def known(labels: DataFrame, key: str, label: str, learn_from: F.Column) -> DataFrame:
    """key and y of all the labels that learn_from admits, one row a key."""
    return labels.where(learn_from & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("y"))


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, learn_from: F.Column, per_kind: int) -> DataFrame:
    """Texts and labels of about per_kind rows of each label; only the few chosen keys are broadcast."""
    told = known(labels, key, label, learn_from)
    some = bounded(told.where("y = 1"), key, per_kind).unionByName(bounded(told.where("y <> 1"), key, per_kind))
    return docs.select(key, text).join(F.broadcast(some), key).select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), "y")


def scored(docs: DataFrame, lexicon: Lexicon, key: str, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([shared.value.score(t.as_py()) for t in b.column(1)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x), pa.array((x >= 0.5).astype(np.int32))], [key, "score", "predicted"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", learn_from: F.Column | None = None, per_kind: int = TRAIN_DOCS, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """key, score and predicted of every row, by a lexicon learned from the labels that learn_from admits."""
    rows = labelled(docs, labels, key, text, label, F.lit(True) if learn_from is None else learn_from, per_kind)
    return scored(docs, learn(rows, exceptions), key, text)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out("doc_id", 5, 0)
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=~out)
    return found.select("doc_id", out.alias("held_out"), "score", "predicted")
