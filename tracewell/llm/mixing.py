"""Mixing sources to target weights by iterative proportional fitting.

Token weights are aggregated to cells (source, language, topic). Raking multiplies the cells' weights until
the token shares of every source, language and topic meet their targets. A document's probability is its
cell's multiplier times one scale, at most 1, with the scale chosen so that the expected number of tokens is the
budget. A document is sampled if a hash of its key and text is below its probability, so a run can be repeated.

Tokens are those of a public tokenizer, counted as in token_counts, unless a column has them. Topics are clusters of hashed
words (spherical k-means, fitted on all documents), unless a column has them. Without given targets, each
marginal's target is its token share to the power `temper`, normalised. Texts are read once: what is measured, counts of hashed words
included, is written to the shared folder, and all that follows reads that. Each round of k-means is one pass over these counts,
whose sums are added up in Spark; it ends when no centre moves by more than STILL, or after TOPIC_ROUNDS.

A cell whose probability would be over 1 keeps all it has and can't give more, so its margins may fall short of their
targets: `marginals` reports target, raked and expected share of each value.

Cells are few (sources x languages x topics), but nothing here relies on it: up to CELLS of them are raked on the
driver, more by the same steps, to the same tolerance, as aggregations in Spark. Raking ends when all margins are met
within CLOSE, or after ROUNDS, which contradictory targets need; `marginals` tells.

Defined results: null sources, languages or topics are values of their own; null and empty texts have no tokens and the
topic null, so they take no part in raking and get the probability of their cell; equal rows share their fate; texts are
read whole; an empty table gives no rows; extra columns pass through, but for those named as a result, which is in their place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import _text, token_counts
from tracewell.llm._spark import dropped, stored, table

CELLS = 100_000
ROUNDS, CLOSE = 100, 1e-9
MARGINS = ("source", "lang", "topic")
#: Topics, hashed words that tell them, rounds at most, and the move of a centre that ends them.
TOPICS, BUCKETS, TOPIC_ROUNDS, STILL = 8, 512, 25, 1e-3
#: Rows of counts that are held as numbers at once, and bytes of text that are hashed at once.
ROWS, HASHED_BYTES = 512, 1 << 16


def word_vectors(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of the hashed lower-case words of each document of a slice."""
    data = _text.LOWER[data]
    s, e, doc = _text.word_spans(data, offs)
    bucket = (_text.span_hashes(data, s, e) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    return np.bincount(doc * BUCKETS + bucket, minlength=(len(offs) - 1) * BUCKETS).reshape(-1, BUCKETS)


def packed(counts: np.ndarray) -> list[bytes]:
    """A row of counts as bytes, last bucket first: a byte each, or 255 and four bytes from there on; bytes sort as the counts do."""
    counts = counts[:, ::-1]
    small = np.minimum(counts, 255).astype(np.uint8)
    if (small < 255).all():
        return [x.tobytes() for x in small]
    return [b"".join(bytes([n]) if n < 255 else b"\xff" + int(n).to_bytes(4, "big") for n in x.tolist()) if (y == 255).any() else y.tobytes() for x, y in zip(counts, small, strict=True)]


def _wide(x: np.ndarray) -> np.ndarray:
    """The counts of one row made by `packed` that has some over a byte, last bucket first."""
    out, at, k = np.zeros(BUCKETS, dtype=np.int64), 0, 0
    for p in np.flatnonzero(x == 255):
        if p >= at:  # else it is one of the four bytes
            out[k : k + p - at] = x[at:p]
            k += p - at + 1
            out[k - 1] = int.from_bytes(x[p + 1 : p + 5].tobytes(), "big")
            at = p + 5
    out[k:] = x[at:]
    return out


def _split(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The rows of counts of a column made by `packed`, in bytes; those that need more are 0 there, and given by row beside it."""
    arr = _text.as_binary(column)
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(data, dtype=np.uint8)
    wide = np.flatnonzero(np.diff(offs) != BUCKETS).tolist()
    if not wide:
        return data[offs[0] : offs[-1]].reshape(-1, BUCKETS)[:, ::-1], {}
    out, at = np.zeros((len(arr), BUCKETS), dtype=np.uint8), 0
    for row in [*wide, len(arr)]:
        out[at:row] = data[offs[at] : offs[row]].reshape(-1, BUCKETS)
        at = row + 1
    return out[:, ::-1], {row: _wide(data[offs[row] : offs[row + 1]])[::-1] for row in wide}


def unpacked(column: pa.Array) -> np.ndarray:
    """The rows of counts of a column made by `packed`."""
    small, wide = _split(column)
    out = small.astype(np.int64) if wide else small
    for row, x in wide.items():
        out[row] = x
    return out


_LOGS = np.log1p(np.arange(256))


def logs(column: pa.Array) -> np.ndarray:
    """log(1 + count) of the rows of a column made by `packed`: looked up, but for the rows with a count over a byte."""
    small, wide = _split(column)
    out = _LOGS.take(small)
    for row, x in wide.items():
        out[row] = np.log1p(x)
    return out


class Topics:
    """Unit vectors of the topics, and the weight of each hashed word."""

    def __init__(self, weight: np.ndarray, centres: np.ndarray):
        self.weight, self.centres = weight, centres

    def weighted(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of rows of `logs`, made in their place, and the length of each."""
        x *= self.weight
        return x, np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)

    def of(self, column: pa.Array) -> list[str | None]:
        """The topic of each row of a column made by `packed`, None without words."""
        if not len(self.centres):
            return [None] * len(column)
        x, size = self.weighted(logs(column))
        best = (x @ self.centres.T).argmax(axis=1)
        return [f"topic{k}" if some else None for k, some in zip(best, size > 1e-12, strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Packed counts and their logs, ROWS at a time."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.column(0).slice(at, ROWS)
            yield part, logs(part)


def _summed(words: DataFrame, shape: tuple[int, int], add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """add() of the logs of all blocks of counts, summed in the tasks and then by place in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in _blocks(batches):
            total += add(x)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

    found = words.mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(shape)
    out.ravel()[found["at"].to_numpy(dtype=np.int64)] = found["n"]
    return out


def topics_of(words: DataFrame, topics: int = TOPICS) -> Topics:
    """Fits on the packed counts of a column of all documents; the order of rows doesn't matter."""
    words = words.where(F.col(words.columns[0]) != F.lit(bytes(BUCKETS))).select(F.col(words.columns[0]).alias("v"))
    n, least = words.agg(F.count("*"), F.min("v")).first()
    if not n:
        return Topics(np.ones(BUCKETS), np.zeros((0, BUCKETS)))
    df = _summed(words, (1, BUCKETS), lambda x: (x > 0).sum(axis=0, keepdims=True))[0]
    found = Topics(np.log((1 + n) / (1 + df)) + 0.1, np.zeros((0, BUCKETS)))

    def first(v: bytes) -> np.ndarray:
        x, size = found.weighted(logs(pa.array([bytes(v)], pa.binary())))
        return x / size[:, None]

    found.centres = first(least)

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for part, x in _blocks(batches):
            x, size = found.weighted(x)
            near = np.round((x @ found.centres.T).max(axis=1) / size, 9)
            low = near.min()
            if best is None or low <= best[0]:
                v = min(part[int(k)].as_py() for k in np.flatnonzero(near == low))
                best = (low, v) if best is None else min(best, (low, v))
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.binary())], ["near", "v"])

    while len(found.centres) < topics:  # the document farthest from all centres is the next
        next_ = words.mapInArrow(farthest, "near double, v binary").agg(F.min(F.struct("near", "v")).alias("m")).first()["m"]
        if next_["near"] > 1 - 1e-9:
            break
        found.centres = np.vstack([found.centres, first(next_["v"])])

    def by_topic(x: np.ndarray) -> np.ndarray:
        x, size = found.weighted(x)
        own = (x @ found.centres.T).argmax(axis=1)
        return np.where(own == np.arange(len(found.centres))[:, None], 1 / size, 0.0) @ x

    for _ in range(TOPIC_ROUNDS):
        sums = _summed(words, found.centres.shape, by_topic)
        sums = np.where(sums.any(axis=1, keepdims=True), sums, found.centres)
        last, found.centres = found.centres, np.round(sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12), 9)
        if np.linalg.norm(found.centres - last, axis=1).max() < STILL:
            break
    return found


def word_counts(column: pa.Array) -> pa.Array:
    return pa.array([x for _, offs, data in _text.slices(column, HASHED_BYTES) for x in packed(word_vectors(data, offs))], pa.binary())


def learned_topics(docs: DataFrame, key: str, text: str) -> Topics:
    """Topics of all rows of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([word_counts(b.column(0))], ["v"])

    words = stored(docs.select(text).mapInArrow(run, "v binary"))
    found = topics_of(words)
    dropped(words)
    return found


def measured(docs: DataFrame, keep: list[str], key: str, text: str, source: str, lang: str, topic: str | None, tokens: str | None) -> DataFrame:
    """The columns keep of docs, and source, lang, topic, tokens and luck (0..1) in five columns after them, named by place."""
    base = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col(source).alias("source"), F.col(lang).alias("lang"), (F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("luck"), (F.col(topic) if topic else F.lit(None).cast("string")).alias("topic"), (F.coalesce(F.col(tokens), F.lit(0)).cast("long") if tokens else F.lit(None).cast("long")).alias("tokens"), F.col(text).alias("text"))
    if topic and tokens:
        return stored(base.drop("text"))
    shared = docs.sparkSession.sparkContext.broadcast(None if tokens else token_counts.fitted_counter(docs, key, text))
    at = {c: base.columns.index(c) for c in base.columns}
    names = [c for c in at if c != "text" and (topic or c != "topic")] + ([] if topic else ["_v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value
        for b in batches:
            new = {}
            texts = b.column(at["text"])
            if counter:
                new["tokens"] = pa.array([counter.count(x.as_py() or "") for x in texts], pa.int64())
            if not topic:
                new["_v"] = word_counts(texts)
            yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(at[c]) for c in names], names)

    found = stored(base.mapInArrow(run, ", ".join(f"`{c}` {'binary' if c == '_v' else base.schema[c].dataType.simpleString()}" for c in names)))
    if topic:
        return found
    topics = docs.sparkSession.sparkContext.broadcast(topics_of(found.select("_v")))

    @F.arrow_udf("string")
    def named(v: pa.Array) -> pa.Array:
        return pa.array([x for k in range(0, len(v), ROWS) for x in topics.value.of(v.slice(k, ROWS))], pa.string())

    return found.withColumn("topic", named("_v")).select(*(c for c in at if c != "text"))


def rake(tokens: np.ndarray, margins: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Multipliers of cells so that the weighted token shares of each margin's values meet its targets.

    margins: for each margin the value number of every cell; targets: shares by value number.
    """
    w = np.ones(len(tokens))
    total = tokens.sum()
    if not total:
        return w
    for _ in range(ROUNDS):
        off = 0.0
        for value, target in zip(margins, targets, strict=True):
            have = np.bincount(value, weights=tokens * w, minlength=len(target)) / (tokens * w).sum()
            factor = np.where(have > 0, target / np.maximum(have, 1e-300), 1.0)
            off = max(off, float(np.abs(have - target)[have > 0].max(initial=0)))
            w = w * factor[value]
        if off < CLOSE:
            break
    return w * total / (tokens * w).sum()


def scale_for(tokens: np.ndarray, w: np.ndarray, share: float) -> float:
    """The scale at which the expected tokens, each cell's probability being at most 1, are share of all."""
    goal, lo, hi = share * tokens.sum(), 0.0, 1.0
    positive = w[(tokens > 0) & (w > 0)]
    if not len(positive) or share >= 1:
        return np.inf if share >= 1 else 1.0
    hi = 1 / positive.min()
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (tokens * np.minimum(1, mid * w)).sum() < goal else (lo, mid)
    return hi


def _targets(names: list, tokens: np.ndarray, given: Mapping | None, temper: float) -> np.ndarray:
    if given is not None:
        t = np.array([max(0.0, given.get(x, 0.0)) for x in names])
    else:
        t = tokens**temper
    return t / t.sum() if t.sum() else np.full(len(names), 1 / max(1, len(names)))


def _raked_on_driver(cells: DataFrame, targets: Mapping[str, Mapping], share: float, temper: float) -> DataFrame:
    rows = cells.orderBy(*(F.col(m).asc_nulls_first() for m in MARGINS)).collect()
    tokens = np.array([r["tokens"] for r in rows], dtype=float)
    values, goals = [], []
    for m in MARGINS:
        number = {x: k for k, x in enumerate(dict.fromkeys(r[m] for r in rows))}
        value = np.array([number[r[m]] for r in rows], dtype=np.int64)
        values.append(value)
        goals.append(_targets([*number], np.bincount(value, weights=tokens, minlength=len(number)), targets.get(m), temper))
    w = rake(tokens, values, goals)
    p = np.minimum(1.0, scale_for(tokens, w, share) * np.maximum(w, 1e-300))
    spark = cells.sparkSession
    schema = ", ".join(f"`{m}` {cells.schema[m].dataType.simpleString()}" for m in MARGINS) + ", weight double, probability double"
    return spark.createDataFrame([(*(r[m] for m in MARGINS), float(a), float(b)) for r, a, b in zip(rows, w, p, strict=True)], schema)


def _goals(cells: DataFrame, m: str, given: Mapping | None, temper: float) -> DataFrame:
    """_m and goal: the target share of each value of a margin."""
    have = cells.groupBy(m).agg(F.sum("tokens").alias("t"))
    if given is not None:
        told = cells.sparkSession.createDataFrame([(k, max(0.0, float(v))) for k, v in given.items()], f"_m {cells.schema[m].dataType.simpleString()}, goal double")
        have = have.join(told, F.col(m).eqNullSafe(F.col("_m")), "left").select(m, F.coalesce("goal", F.lit(0.0)).alias("goal"))
    else:
        have = have.select(m, F.pow("t", F.lit(temper)).alias("goal"))
    share_of = F.when(F.col("all") > 0, F.col("goal") / F.col("all")).otherwise(1 / F.col("n"))
    return have.crossJoin(have.agg(F.sum("goal").alias("all"), F.count("*").alias("n"))).select(F.col(m).alias("_m"), share_of.alias("goal"))


def _raked_in_spark(cells: DataFrame, targets: Mapping[str, Mapping], share: float, temper: float) -> DataFrame:
    """The same steps, to the same tolerance, over a table of cells that is too large for the driver."""
    now = stored(cells.withColumn("weight", F.lit(1.0)))
    total = now.agg(F.sum("tokens")).first()[0] or 0
    goals = {m: stored(_goals(now, m, targets.get(m), temper)) for m in MARGINS}
    for _ in range(ROUNDS if total else 0):
        off, old = 0.0, [now]
        for m in MARGINS:
            have = now.groupBy(m).agg(F.sum(F.col("tokens") * F.col("weight")).alias("t"))
            f = stored(have.join(goals[m], F.col(m).eqNullSafe(F.col("_m"))).select("_m", "t", "goal"))
            old.append(f)
            all_ = f.agg(F.sum("t")).first()[0]
            off = max(off, f.where("t > 0").agg(F.max(F.abs(F.col("t") / all_ - F.col("goal")))).first()[0] or 0.0)
            f = f.select("_m", F.when(F.col("t") > 0, F.col("goal") * all_ / F.col("t")).otherwise(1.0).alias("f"))
            now = now.join(f, F.col(m).eqNullSafe(F.col("_m"))).select(*MARGINS, "tokens", (F.col("weight") * F.col("f")).alias("weight"))
        now = stored(now)
        dropped(*old)
        if off < CLOSE:
            break
    if total:
        now = now.withColumn("weight", F.col("weight") * (total / now.agg(F.sum(F.col("tokens") * F.col("weight"))).first()[0]))
    scale = _scale_in_spark(now, share, total)
    return now.select(*MARGINS, "weight", F.least(F.lit(1.0), F.greatest("weight", F.lit(1e-300)) * scale).alias("probability"))


def _scale_in_spark(cells: DataFrame, share: float, total: float) -> float:
    """scale_for over a table of cells: five halvings in each of 20 passes."""
    least = cells.where("tokens > 0 and weight > 0").agg(F.min("weight")).first()[0]
    if share >= 1 or least is None:
        return float("inf") if share >= 1 else 1.0
    lo, hi = 0.0, 1 / least
    for _ in range(20):
        at = [lo + (hi - lo) * k / 32 for k in range(33)]
        have = cells.agg(*(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * x)) for x in at[1:32])).first()
        under = sum(x < share * total for x in have)  # they grow with the scale
        lo, hi = at[under], at[under + 1]
    return hi


def _calibrated(docs: DataFrame, keep: list[str], key: str, text: str, source: str, lang: str, topic: str | None, tokens: str | None, targets: Mapping[str, Mapping] | None, share: float, temper: float) -> tuple[DataFrame, DataFrame]:
    """What `measured` gives, with weight, probability and sampled; and the cells with tokens, weight and probability."""
    full = measured(docs, keep, key, text, source, lang, topic, tokens)
    cells = stored(full.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    few = cells.count() <= CELLS
    found = (_raked_on_driver if few else _raked_in_spark)(cells, targets or {}, share, temper)
    found = found.withColumnsRenamed({m: f"_{m}" for m in MARGINS})
    same = lambda left: [left[m].eqNullSafe(F.col(f"_{m}")) for m in MARGINS]
    side = F.broadcast(found) if few else found
    rows = full.join(side, same(full)).drop(*(f"_{m}" for m in MARGINS)).withColumn("sampled", F.col("luck") < F.col("probability"))
    return rows, cells.join(side, same(cells)).drop(*(f"_{m}" for m in MARGINS))


def calibrated(docs: DataFrame, key: str = "doc_id", text: str = "text", *, source: str = "source", lang: str = "lang", topic: str | None = None, tokens: str | None = None, targets: Mapping[str, Mapping] | None = None, share: float = 0.5, temper: float = 0.7) -> DataFrame:
    """docs with _tokens, _topic, _weight (of its cell), _probability and _sampled."""
    new = ["_tokens", "_topic", "_weight", "_probability", "_sampled"]
    keep = [c for c in docs.columns if c not in new]
    rows, _ = _calibrated(docs, keep, key, text, source, lang, topic, tokens, targets, share, temper)
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), *(F.col(c[1:]).alias(c) for c in new))


def marginals(docs: DataFrame, key: str = "doc_id", text: str = "text", *, source: str = "source", lang: str = "lang", topic: str | None = None, tokens: str | None = None, targets: Mapping[str, Mapping] | None = None, share: float = 0.5, temper: float = 0.7) -> DataFrame:
    """margin, value, target, raked and expected: shares of tokens for each value of each margin.

    raked are those of the weights; expected are those of the sample, which differ where probabilities reach 1.
    """
    _, cells = _calibrated(docs, [], key, text, source, lang, topic, tokens, targets, share, temper)
    cells = stored(cells)
    all_ = cells.agg(F.sum(F.col("tokens") * F.col("weight")).alias("w"), F.sum(F.col("tokens") * F.col("probability")).alias("p")).first()
    out = None
    for m in MARGINS:
        have = cells.groupBy(m).agg((F.sum(F.col("tokens") * F.col("weight")) / F.lit(all_["w"] or 1.0)).alias("raked"), (F.sum(F.col("tokens") * F.col("probability")) / F.lit(all_["p"] or 1.0)).alias("expected"))
        rows = have.join(_goals(cells, m, (targets or {}).get(m), temper), F.col(m).eqNullSafe(F.col("_m"))).select(F.lit(m).alias("margin"), F.col(m).cast("string").alias("value"), F.col("goal").alias("target"), "raked", "expected")
        out = rows if out is None else out.unionByName(rows)
    return out


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of docs, with their cell's topic, weight and probability."""
    renamed = {c: f"{c}_{uuid.uuid4().hex}" for c in ("_tokens", "_topic", "_weight", "_probability", "_sampled") if c in docs.columns}
    options = {k: renamed.get(v, v) if isinstance(v, str) else v for k, v in options.items()}
    rows = calibrated(docs.withColumnsRenamed(renamed), **options).where("_sampled")
    new = {"mix_topic": "_topic", "mix_weight": "_weight", "mix_probability": "_probability"}
    return rows.select(*(F.col(renamed.get(c, c)).alias(c) for c in docs.columns if c not in new), *(F.col(c).alias(n) for n, c in new.items()))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, _ = _calibrated(docs, ["doc_id"], "doc_id", "text", "source", "lang", None, None, None, 0.5, 0.7)
    return rows.select(F.col("c0").alias("doc_id"), "source", "lang", "topic", F.col("tokens").alias("n_tokens"), "weight", "probability", "sampled")
