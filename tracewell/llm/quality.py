"""Document quality: Bradley-Terry scores learned from preference pairs.

Each document has a vector of surface statistics. A pair prefers a document labelled 1 to one labelled
0; the probability of the preference is the logistic function of the difference of their scores, and a
score is linear in the statistics. The weights minimise the logistic loss over all pairs of labelled documents.
Pairs aren't listed: each round of Newton's method sums counts, statistics and their products by label and narrow class
of scores, and pairs of classes stand for their pairs of documents, at the classes' mean scores (WIDTH; the sum is off by
about a 1e-5th). The threshold separates all labelled documents best, to a GRID-th of the range of scores, so that it is
0.5 after the logistic map. Texts are read once: their vectors are written to the shared folder, and all that follows reads these.

Defined results: null and empty texts have the vector of zeros and are scored like any other; texts
are read whole; repeated rows get equal scores; without labels of both kinds all weights are 0 and every
score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import _text
from tracewell.llm._spark import dropped, stored, table
from tracewell.llm.language_id import held_out
from tracewell.llm.toxicity import known

#: Preference pairs that `fit` draws from rows in memory.
PAIRS = 40_000
#: Width of a class of scores up to LINEAR from the mean (beyond, it grows with the distance), and steps of the threshold.
WIDTH, LINEAR, GRID = 1 / 16, 8.0, 1 << 16

FEATURES = ("log_words", "word_bytes", "upper", "symbols", "marks", "digits", "bars", "same_as_last", "repeated_words", "repeated_shingles", "symbol_words", "upper_words", "line_words")

_kind = np.zeros((7, 256), dtype=bool)
_kind[0, 65:91] = True  # upper
_kind[1, 97:123] = True  # lower
_kind[1, 128:] = True
_kind[2, [ord(c) for c in "#*$%&<>=~^_{}[]\\@"]] = True
_kind[3, [ord(c) for c in "!?"]] = True
_kind[4, 48:58] = True
_kind[5, ord("|")] = True
_kind[6, 10] = True


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document of a slice; shares of 0..1 but for the first two and the last."""
    docs = len(offs) - 1
    out = np.zeros((docs, len(FEATURES)))
    if not len(data):
        return out
    sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[offs])
    size = np.maximum(np.diff(offs), 1)
    upper, lower, signs, marks, digits, bars, lines = (sums(k[data]) for k in _kind)
    s, e, doc = _text.word_spans(data, offs)
    words = np.bincount(doc, minlength=docs)
    n = np.maximum(words, 1)
    h = _text.span_hashes(data, s, e)
    same = np.zeros(len(s), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])

    def repeated(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        """How many values of each document equal an earlier one of it."""
        order = np.lexsort((values, of))
        v, d = values[order], of[order]
        again = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
        return np.bincount(d[1:][again], minlength=docs)

    shingles, at = _text.shingle_hashes(data, offs, 3)
    per = np.diff(at)
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.log1p(np.bincount(doc, weights=e - s, minlength=docs) / n)
    out[:, 2] = upper / np.maximum(upper + lower, 1)
    out[:, 3], out[:, 4], out[:, 5], out[:, 6] = signs / size, marks / size, digits / size, bars / size
    out[:, 7] = np.bincount(doc[same], minlength=docs) / n
    out[:, 8] = repeated(h, doc) / n
    out[:, 9] = repeated(shingles, np.repeat(np.arange(docs), per)) / np.maximum(per, 1)
    last = data[np.maximum(e - 1, 0)] if len(e) else e.astype(np.uint8)
    out[:, 10] = np.bincount(doc[_kind[2][last] | _kind[3][last]], minlength=docs) / n
    first_upper = _kind[0][data[s]] & ((e - s) > 2) & _kind[0][data[np.minimum(s + 1, len(data) - 1)]] if len(s) else same
    out[:, 11] = np.bincount(doc[first_upper], minlength=docs) / n
    out[:, 12] = np.log1p(words / (lines + 1))
    return out


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-2, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and threshold from rows in memory; Newton's method on the Bradley-Terry loss of drawn pairs. The query uses `learned`."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    w = np.zeros(x.shape[1] if x.ndim == 2 else len(FEATURES))
    if not len(good) or not len(bad):
        return w, 0.0
    rng = np.random.default_rng(7)
    diff = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    scale = x.std(axis=0) + 1e-9
    diff = diff / scale
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))  # of the wrong order
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w)), diff.T @ p / pairs - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    w = w / scale
    scores = np.sort(x @ w)
    ranks = np.linspace(0, 1, 401)
    cuts = np.quantile(scores, ranks)
    own = x @ w
    wrong = [np.mean(own[good] < c) + np.mean(own[bad] >= c) for c in cuts]
    best = np.flatnonzero(np.isclose(wrong, min(wrong)))
    return w, float(cuts[best[len(best) // 2]])


def vectors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k (the key) and the feature vector of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, offs, data in _text.slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0)[row : row + len(offs) - 1], *map(pa.array, features(data, offs).T)], ["k", *FEATURES])

    return docs.select(key, text).mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{f} double" for f in FEATURES))


def linear(w: np.ndarray) -> F.Column:
    """The sum of the features times w."""
    return sum((F.col(f) * F.lit(float(x)) for f, x in zip(FEATURES[1:], w[1:], strict=True)), F.col(FEATURES[0]) * F.lit(float(w[0])))


def learned(rows: DataFrame, ridge: float = 1e-2, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and threshold from all pairs of rows (good, FEATURES); sums by class of scores reach the driver."""
    size = len(FEATURES)
    first = rows.agg(F.count("*"), F.count_if("good"), *(F.avg(f) for f in FEATURES), *(F.stddev_pop(f) for f in FEATURES)).first()
    n, n_good = first[0], first[1]
    v = np.zeros(size)
    if not n_good or n_good == n:
        return v, 0.0
    mean, scale = np.array(first[2 : 2 + size]), np.array(first[2 + size :]) + 1e-9
    unit = rows.select("good", *(((F.col(f) - F.lit(float(m))) / F.lit(float(s))).alias(f) for f, m, s in zip(FEATURES, mean, scale, strict=True)))
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [F.count("*"), *(F.sum(f) for f in FEATURES), *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in upper)]
    for _ in range(rounds):
        cell = F.round(F.asinh(linear(v) / LINEAR) * (LINEAR / WIDTH)).cast("int")
        cells = unit.groupBy("good", cell.alias("cell")).agg(*(c.alias(f"s{k}") for k, c in enumerate(sums))).toPandas().sort_values(["good", "cell"])
        side = []
        for kind in (True, False):
            x = cells[cells["good"] == kind].iloc[:, 2:].to_numpy(dtype=float)
            square = np.empty((len(x), size, size))
            for k, (i, j) in enumerate(upper):
                square[:, i, j] = square[:, j, i] = x[:, 1 + size + k]
            side.append((x[:, 0], x[:, 1 : 1 + size], square))
        (na, xa, sa), (nb, xb, sb) = side
        ca, cb = xa @ v / na, xb @ v / nb
        p = 1 / (1 + np.exp(np.clip(ca[:, None] - cb[None, :], -40, 40)))  # of the wrong order
        q = p * (1 - p)
        # Within a class, scores and statistics move together: the products tell by how much.
        slope = (q @ nb) @ (sa @ v - ca[:, None] * xa) + (na @ q) @ (sb @ v - cb[:, None] * xb)
        cross = xa.T @ q @ xb
        bend = np.tensordot(q @ nb, sa, 1) + np.tensordot(na @ q, sb, 1) - cross - cross.T
        pairs = float(n_good) * (n - n_good)
        step = np.linalg.solve(bend / pairs + ridge * np.eye(size), (xa.T @ (p @ nb) - xb.T @ (na @ p) - slope) / pairs - ridge * v)
        v = v + step
        if np.abs(step).max() < 1e-5:
            break
    w = np.array([float(f"{x:.9e}") for x in v / scale])  # sums differ in their last digits with the order of rows
    return w, cut(rows.select("good", linear(w).alias("s")))


def cut(scores: DataFrame) -> float:
    """The threshold that separates rows (good, s) best, both kinds counting alike: the middle of the best steps."""
    lo, hi = scores.agg(F.min("s"), F.max("s")).first()
    step = (hi - lo) / GRID or 1.0
    found = scores.groupBy("good", F.floor((F.col("s") - lo) / step).cast("int").alias("at")).count().toPandas()
    good, bad = (np.bincount(x["at"], weights=x["count"], minlength=GRID + 2) for x in (found[found["good"]], found[~found["good"]]))
    under = lambda x: np.concatenate(([0], np.cumsum(x) / x.sum()))
    wrong = under(good) - under(bad)
    best = np.flatnonzero(np.isclose(wrong, wrong.min(), atol=1e-12))
    return float(f"{lo + best[len(best) // 2] * step:.9e}")


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", learn_from: F.Column | None = None) -> DataFrame:
    """key, score and predicted of every row, by weights learned from all the labels that learn_from admits."""
    every = stored(vectors(docs, key, text))
    told = known(labels, key, label, F.lit(True) if learn_from is None else learn_from)
    rows = stored(every.join(told.select(F.col(key).alias("k"), (F.col("y") == 1).alias("good")), "k").select("good", *FEATURES))
    w, threshold = learned(rows)
    dropped(rows)
    away = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.lit(threshold) - linear(w)))
    return every.select(F.col("k").alias(key), (1 / (1 + F.exp(away))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out("doc_id", 3, 1)
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=~out)
    return found.select("doc_id", out.alias("held_out"), "score", "predicted")
