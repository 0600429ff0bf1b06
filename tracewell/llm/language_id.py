"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is folded to lower case, each run of characters that aren't letters becomes one blank, and
the n-grams of 1 to 3 characters are hashed to a fixed number of buckets. The log-probability matrix
(languages x buckets) is learned from every document that has a language, in one pass, and broadcast; a slice of documents is scored at once: the n-grams of all of them are gathered from
it and summed by document, which is the sparse count matrix times that matrix.

Defined results: null, empty or letterless texts are `und` with score 0; texts are read whole; ties go
to the language first in order; repeated rows get equal results; with nothing to learn from, all rows are
`und` with score 0; an empty table gives no rows; other columns are ignored. Rows without a language
aren't learned from.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._spark import table

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
#: Characters of text that are counted or scored at once; a longer text is taken in parts that add up. And rows held as strings at once.
SLICE_CHARS, ROWS = 1 << 17, 500
UND = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def folded(text: str) -> np.ndarray:
    """Code points of the text with single blanks between and around its runs of letters."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[c]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    return np.where(letter, c, 32)[keep].astype(np.uint64)


def grams(c: np.ndarray, size: int) -> np.ndarray:
    """Buckets of the n-grams of a code point sequence."""
    n = len(c) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.full(n, size * 0x9E3779B97F4A7C15 % (1 << 64), dtype=np.uint64)
    for k in range(size):
        h = (h ^ c[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _folded_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What `folded` gives for each text, one after the other, and the number of the text of each place."""
    joined = " \0 ".join(t.replace("\0", " ") for t in texts).lower()
    c = np.frombuffer(f" {joined} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[c]
    ends = c == 0
    keep = letter.copy()
    keep[1:] |= letter[:-1] | ends[:-1]
    keep[0] = True
    return np.where(letter, c, 32)[keep].astype(np.uint64), np.cumsum(ends)[keep]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """First and end of slices of about SLICE_CHARS; a longer text is one of its own."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= SLICE_CHARS:
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def _grams_within(c: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams that lie within one text, and the number of that text, in parts."""
    for lo in range(0, len(c), 2 * SLICE_CHARS):
        for n in SIZES:
            part = slice(lo, lo + 2 * SLICE_CHARS + n - 1)
            d = doc[part]
            inside = d[: len(d) - n + 1] == d[n - 1 :]
            yield grams(c[part], n)[inside], d[: len(d) - n + 1][inside]


def gram_counts(texts: list[str]) -> np.ndarray:
    """How many n-grams of the texts each bucket has."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at, end in _slices(texts):
        for g, _ in _grams_within(*_folded_batch(texts[at:end])):
            total += np.bincount(g, minlength=BUCKETS)
    return total


def fit(docs: DataFrame, key: str, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities, one row of BUCKETS each, then the log prior in a last column; from all rows with a language."""
    known = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    sizes = {r.l: r["count"] for r in known.groupBy("l").count().collect()}  # a row for each language
    if not sizes:
        return [], np.zeros((0, BUCKETS + 1), dtype=np.float32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                texts: dict[str, list[str]] = {}
                for t, x in zip(b.column(0).slice(at, ROWS), b.column(1).slice(at, ROWS).to_pylist(), strict=True):
                    texts.setdefault(x, []).append(t.as_py() or "")
                for x, some in texts.items():
                    total[x] = total.get(x, 0) + gram_counts(some)
        for x, have in total.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at), pa.array(have[at])], ["l", "bucket", "n"])

    found = known.mapInArrow(count, "l string, bucket long, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes)
    counts = np.zeros((len(langs), BUCKETS))
    counts[[langs.index(x) for x in found["l"]], found["bucket"].to_numpy(dtype=np.int64)] = found["n"]
    counts += 0.5
    prior = np.log([sizes[x] / sum(sizes.values()) for x in langs])
    return langs, np.column_stack([np.log(counts / counts.sum(axis=1, keepdims=True)), prior]).astype(np.float32)


def score_batch(texts: list[str], logp: np.ndarray) -> np.ndarray:
    """Log joint probability of each text (texts x languages); the rows of letterless texts are NaN.

    The sparse matrix of n-gram counts times the matrix of log-probabilities: the rows that the n-grams of all texts
    name are gathered and summed by text. A slice of the texts holds about SLICE_CHARS; a longer text is scored in parts.
    """
    out = np.full((len(texts), len(logp)), np.nan)
    if not len(logp):
        return out
    for at, end in _slices(texts):
        c, doc = _folded_batch(texts[at:end])
        known = np.flatnonzero(np.bincount(doc, minlength=end - at) > 1)
        total = np.zeros((end - at, len(logp)))
        for g, d in _grams_within(c, doc):
            if not len(g):
                continue
            first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            for k in range(len(logp)):
                total[d[first], k] += np.add.reduceat(np.take(logp[k], g), first, dtype=np.float64)
        out[at + known] = total[known] + logp[:, -1]
    return out


def score_text(text: str | None, logp: np.ndarray) -> np.ndarray | None:
    """The same of one text, None without letters."""
    found = score_batch([text or ""], logp)[0]
    return None if not len(logp) or np.isnan(found[0]) else found


def _decided(column: pa.Array, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the likeliest language of each text of a column, -1 where it can't be told, and its posterior, then 0."""
    n = len(column)
    best, score = np.full(n, -1), np.zeros(n)
    for at in range(0, n, ROWS):
        total = score_batch([x.as_py() or "" for x in column.slice(at, ROWS)], logp)
        known = np.flatnonzero(~np.isnan(total[:, :1]).any(axis=1)) if total.size else np.zeros(0, dtype=np.int64)
        top = total[known].max(axis=1, initial=-np.inf)
        best[at + known] = total[known].argmax(axis=1) if len(known) else 0
        score[at + known] = 1 / np.exp(total[known] - top[:, None]).sum(axis=1)
    return best, score


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str, text: str) -> DataFrame:
    """key, lang_pred and score (the posterior of the predicted language) of every row."""
    langs = model[0]
    logp = docs.sparkSession.sparkContext.broadcast(model[1])
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, scores = _decided(b.column(1), logp.value)
            names = [UND if k < 0 else langs[k] for k in best]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def held_out(key: str, mod: int, rest: int) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % mod == rest, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", learn_from: F.Column | None = None) -> DataFrame:
    """Fits on the rows that learn_from admits (all if None) and predicts every row."""
    return predict(docs, fit(docs if learn_from is None else docs.where(learn_from), key, text, lang), key, text)


def keep_identified(docs: DataFrame, min_score: float = 0.5, **options) -> DataFrame:
    """docs without the rows whose language can't be told: `und`, or a posterior under min_score.

    The decision is made for each row where it stands, so rows with equal or null keys are no matter.
    """
    key, text, lang = options.get("key", "doc_id"), options.get("text", "text"), options.get("lang", "lang")
    langs, logp = fit(docs, key, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(logp)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, score = _decided(b.column(at), shared.value)
            yield b.filter(pa.array((best >= 0) & (score >= min_score)))

    return docs.mapInArrow(run, docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    return identify(docs, learn_from=~out).select("doc_id", out.alias("held_out"), "lang_pred", "score")
