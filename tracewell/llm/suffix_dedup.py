"""Removal of repeated byte strings by blockwise suffix sorting with difference-cover ranks.

A byte is removed if a string of LENGTH bytes that covers it also starts elsewhere in the corpus. What
decides is the order of suffixes: those with the same first LENGTH bytes are neighbours.

Suffix buckets. The suffixes of a bucket share the anchor of their first LENGTH bytes: the GRAM-byte string of the
smallest hash in it. Equal strings have equal anchors at equal offsets, so a bucket never splits a group of
ties, buckets are sorted independently, and an anchor that occurs once proves that its suffixes don't repeat, so
these are left out before any text moves. About one position in 76 is an anchor. Equal surroundings of an
anchor (all bytes that its suffixes' first LENGTH bytes span) are one row with a count.

Sorting. Buckets are sorted a block of them at a time. In a block, the suffixes at cover positions (a perfect
difference cover modulo 13) are ranked first, from right to left: by the bytes up to the next cover
position, then by that one's rank. Every suffix is then sorted by its bytes up to the next cover position, at
most 6, and that position's rank, one 64-bit key, so a tie of any length costs one comparison, and memory is
bounded by the block. Runs of neighbours that have LENGTH bytes in common and number two or more are repeated: neighbours of
one key agree to their ends, others are compared byte by byte where their first bytes agree.

A bucket with more than BUCKET different surroundings isn't gathered: its suffixes are counted as rows keyed by the
hash of their first LENGTH bytes, aggregated before the shuffle. Nothing is dropped.

Defined results: a null text counts as empty; matches never cross documents; texts are read whole; rows that
repeat a key or have a null one are told apart by their text, and those equal in both get the same result; an
empty table gives no rows; other columns are ignored. Where the kept text is asked for, a character of which some bytes
were removed goes as a whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import _text
from tracewell.llm._spark import dropped, stored, table

LENGTH, GRAM = 200, 48
#: k-grams in LENGTH bytes: the offset of an anchor in a string is less than this.
REACH = LENGTH - GRAM + 1
BEFORE = REACH - 1
WIDTH = BEFORE + LENGTH
#: Perfect difference cover: every residue modulo PERIOD is a difference of two of COVER.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Surroundings that are sorted as one block (up to a bucket more), and the most that a bucket may have.
BLOCK, BUCKET = 8_192, 16_384
#: Bytes of neighbours that are compared at once.
STEP = 25
#: Bytes of a document that are searched for anchors at once; below 2**POSITION_BITS.
PIECE, POSITION_BITS = 1 << 25, 26
U64 = np.uint64


def _totals(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_text.byte_codes(5)[data] * _text.powers(_text.BASE, len(data)), out=total[1:])
    return total


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all LENGTH-byte strings of the documents, and their hashes."""
    n = len(data)
    if n > PIECE:  # one long document, in pieces that share LENGTH - 1 bytes
        found = [(p + at, h) for at in range(0, n, PIECE - LENGTH) for p, h in [anchors(data[at : at + PIECE], np.array([0, min(PIECE, n - at)]))]]
        pos, first = np.unique(np.concatenate([p for p, _ in found]), return_index=True)
        return pos, np.concatenate([h for _, h in found])[first]
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    if n < LENGTH:
        return none
    total = _totals(data)
    grams = n - GRAM + 1
    h = _text.mix((total[GRAM:] - total[:-GRAM]) * _text.powers(_text.BASE_INV, grams))
    low = (h >> U64(POSITION_BITS) << U64(POSITION_BITS)) | np.arange(grams, dtype=np.uint64)
    span = 1
    while span * 2 <= REACH:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: grams - REACH + 1], low[REACH - span :][: grams - REACH + 1])
    inside = np.zeros(n + 1, dtype=np.int64)
    long = np.diff(offs) >= LENGTH
    if not long.any():
        return none
    inside[offs[:-1][long]] += 1
    np.subtract.at(inside, offs[1:][long] - LENGTH + 1, 1)
    pos = (low[np.cumsum(inside)[: len(low)] > 0] & U64((1 << POSITION_BITS) - 1)).astype(np.int64)
    pos = pos[np.concatenate(([True], pos[1:] != pos[:-1]))]
    return pos, h[pos]


def _anchored(docs: DataFrame) -> DataFrame:
    """k, th, pos, h, g: the anchors of each document, h the anchor's hash, g that of its surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, offs, data in _text.slices(b.column(2)):
                pos, h = anchors(data, offs)
                if not len(pos):
                    continue
                doc = np.searchsorted(offs, pos, side="right") - 1
                lo, hi = np.maximum(pos - BEFORE, offs[doc]), np.minimum(pos + LENGTH, offs[doc + 1])
                total = _totals(data)
                g = _text.mix((total[hi] - total[lo]) * _text.powers(_text.BASE_INV, len(data) + 1)[lo] + (((pos - lo) << 10) + hi - pos).astype(np.uint64) * U64(0xA0761D6478BD642F))
                at = pa.array(doc + row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(pos - offs[doc]), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], ["k", "th", "pos", "h", "g"])

    return docs.mapInArrow(run, f"k {docs.schema['k'].dataType.simpleString()}, th long, pos long, h long, g long")


def _surroundings(docs: DataFrame) -> DataFrame:
    """h, g, n, hot, lead and the bytes around each wanted anchor of rows (t, want)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text, want in zip(_text.as_binary(b.column(0)), b.column(1), strict=True):
                text = text.as_py()
                for w in want.as_py():
                    lo = max(0, w["pos"] - BEFORE)
                    for c, v in zip(cols, (w["h"], w["g"], w["n"], w["hot"], w["pos"] - lo, text[lo : w["pos"] + LENGTH]), strict=True):
                        c.append(v)
                if len(cols[0]) >= 20_000:
                    yield batch(cols)
                    cols = [[] for _ in range(6)]
            yield batch(cols)

    def batch(cols: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["h", "g", "n", "hot", "lead", "bytes"])

    return docs.mapInArrow(run, "h long, g long, n long, hot boolean, lead int, bytes binary")


def _matrix(lead: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Surroundings by column (WIDTH x rows, zeros where the document ends), and the first and last start of a whole string in each."""
    m = np.zeros((len(texts), WIDTH), dtype=np.uint8)
    for k, x in enumerate(texts):
        at = BEFORE - lead[k]
        m[k, at : at + len(x)] = np.frombuffer(x, dtype=np.uint8)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.ascontiguousarray(m.T), BEFORE - lead, BEFORE - lead + size - LENGTH


def _string_hashes(cols: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(x, hash of the LENGTH bytes from x on of every row) for x = BEFORE .. 0."""
    codes, power, total = _text.byte_codes(6), _text.powers(_text.BASE, WIDTH), [np.zeros(cols.shape[1], dtype=np.uint64)]
    for x in range(WIDTH):
        total.append(total[-1] + codes[cols[x]] * power[x])
    inverse = _text.powers(_text.BASE_INV, WIDTH)
    for x in range(BEFORE, -1, -1):
        yield x, (total[x + LENGTH] - total[x]) * inverse[x]


def _differ(cols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the columns a and b differ, by STEP rows at a time, as most that do differ early."""
    out = np.zeros(len(a), dtype=bool)
    left = np.arange(len(a))
    for at in range(0, len(cols), STEP):
        other = (cols[at : at + STEP, a[left]] != cols[at : at + STEP, b[left]]).any(axis=0)
        out[left[other]] = True
        left = left[~other]
    return out


def sort_block(lead: np.ndarray, texts: list[bytes], n: np.ndarray) -> np.ndarray:
    """Which strings of a block's surroundings are repeated: REACH x rows, by start."""
    cols, first, last = _matrix(lead, texts)
    rows = len(texts)
    assert rows < 1 << 16
    out = np.zeros((REACH, rows), dtype=bool)
    rank, cover = np.zeros(rows, dtype=np.uint64), WIDTH
    for x in range(WIDTH - 1, -1, -1):
        sample = x % PERIOD in COVER
        if x > BEFORE and not sample:
            continue
        key = np.zeros(rows, dtype=np.uint64)
        for c in range(x, cover):
            key = (key << U64(8)) | cols[c]
        key = (key << U64(16)) | rank
        order = np.argsort(key)
        if x <= BEFORE:
            whole = np.where((first <= x) & (x <= last), n, 0)[order]
            near = key[order]
            differs = near[1:] != near[:-1]
            unsure = np.flatnonzero(differs & (near[1:] >> U64(16) == near[:-1] >> U64(16)))
            differs[unsure] = _differ(cols[x : x + LENGTH], order[unsure], order[unsure + 1])
            starts = np.flatnonzero(np.concatenate(([True], differs)))
            total = np.add.reduceat(whole, starts)
            out[x, order] = (np.repeat(total, np.diff(np.append(starts, rows))) > 1) & (whole > 0)
        if sample:
            key = key[order]
            rank = np.empty(rows, dtype=np.uint64)
            rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))).astype(np.uint64)
            cover = x
    return out


def _runs(marks: np.ndarray) -> pa.Array:
    """First and last start of each run of marked ones, a list for each column of marks."""
    edge = np.diff(np.pad(marks.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, lo = np.nonzero(edge == 1)
    hi = np.nonzero(edge == -1)[1] - 1
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], 2 * np.cumsum(np.bincount(row, minlength=marks.shape[1])))), pa.int32()), pa.array(np.column_stack([lo, hi]).ravel().astype(np.int32)))


def _sorted_blocks(around: DataFrame) -> DataFrame:
    """h, g and the runs of repeated starts of the surroundings that have any; buckets are whole in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            runs = _runs(sort_block(t["lead"].to_numpy(), t["bytes"].to_pylist(), t["n"].to_numpy()))
            return pa.RecordBatch.from_arrays([t["h"].combine_chunks(), t["g"].combine_chunks(), runs], ["h", "g", "runs"]).filter(pa.compute.greater(pa.compute.list_value_length(runs), 0))

        for b in batches:
            h = b.column(0).to_numpy()
            at = 0
            while at < len(h):
                if rows < BLOCK:
                    take = min(len(h) - at, BLOCK - rows)
                else:  # to the end of the last bucket
                    last = held[-1].column(0)[-1].as_py()
                    take = int(np.searchsorted(h[at:] != last, True)) if (h[at:] != last).any() else len(h) - at
                    if not take:
                        yield done(held)
                        held, rows = [], 0
                        continue
                held.append(b.slice(at, take))
                rows += take
                at += take
        if held:
            yield done(held)

    return around.select("h", "g", "n", "lead", "bytes").repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, g long, runs array<int>")


def _counted(around: DataFrame) -> DataFrame:
    """The same for the surroundings of hot buckets, by counting strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4_096):
                p = b.slice(at, 4_096)
                cols, first, last = _matrix(p.column(3).to_numpy(), p.column(4).to_pylist())
                for x, w in _string_hashes(cols):
                    ok = pa.array((first <= x) & (x <= last))
                    yield pa.RecordBatch.from_arrays([*(p.column(k).filter(ok) for k in range(3)), pa.array(np.full(len(ok), x, np.int32)).filter(ok), pa.array(w.view(np.int64)).filter(ok)], ["h", "g", "n", "x", "w"])

    strings = around.select("h", "g", "n", "lead", "bytes").mapInArrow(run, "h long, g long, n long, x int, w long")
    again = strings.groupBy("h", "x", "w").agg(F.sum("n").alias("total")).where("total > 1").select("h", "x", "w")
    return strings.join(again, ["h", "x", "w"]).groupBy("h", "g").agg(F.flatten(F.transform(F.sort_array(F.collect_set("x")), lambda x: F.array(x, x))).alias("runs"))


def _cut(text: bytes, found: list | None) -> np.ndarray:
    """Which bytes of a text go."""
    edge = np.zeros(len(text) + 1, dtype=np.int32)
    for f in found or ():
        runs = f["runs"]
        for lo, hi in zip(runs[::2], runs[1::2], strict=True):
            edge[f["pos"] - BEFORE + lo] += 1
            edge[f["pos"] - BEFORE + hi + LENGTH] -= 1
    return np.cumsum(edge)[: len(text)] > 0


def repeated_strings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, th, found: for documents with repeated strings, their anchors and the runs of starts around them."""
    plain = _plain(docs, key, text)
    every = stored(_anchored(plain))
    # Aggregates are written before they are joined, so that the join's other side, in which an anchor may be hot, can be split.
    twice = stored(every.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"))
    again = stored(every.join(twice, "h"))
    dropped(every, twice)
    once = stored(again.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("k", "th", "pos")).alias("at")))
    sizes = stored(once.groupBy("h").agg((F.count("*") > BUCKET).alias("hot")))
    want = once.join(sizes, "h").groupBy(F.col("at.k").alias("wk"), F.col("at.th").alias("wth")).agg(F.collect_list(F.struct(F.col("at.pos").alias("pos"), "h", "g", "n", "hot")).alias("want"))
    around = stored(_surroundings(plain.join(want, plain["k"].eqNullSafe(want["wk"]) & (plain["th"] == want["wth"])).select("t", "want")))
    runs = stored(_sorted_blocks(around.where("not hot")).unionByName(_counted(around.where("hot"))).dropDuplicates(["h", "g"]))
    found = stored(again.join(runs, ["h", "g"]).groupBy("k", "th").agg(F.collect_list(F.struct("pos", "runs")).alias("found")))
    dropped(again, once, sizes, around, runs)
    return found


def _plain(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("t"))


def dedup_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    found = repeated_strings(docs, key, text)
    plain = _plain(docs, key, text)
    both = plain.join(found.withColumnsRenamed({"k": "fk", "th": "fth"}), plain["k"].eqNullSafe(F.col("fk")) & (plain["th"] == F.col("fth")), "left").select("k", "t", "found")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t, f in zip(_text.as_binary(b.column(1)), b.column(2), strict=True):
                t, f = t.as_py(), f.as_py()
                if not f:
                    out.append((len(t), 0, 0, hashlib.sha256(t).hexdigest()))
                    continue
                gone = _cut(t, f)
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()).hexdigest()))
            n, r, s, h = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(h, pa.string())], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str | None = None) -> DataFrame:
    """docs with what repeats cut out of text, and the number of characters left in the column named by size, if any."""
    own = uuid.uuid4().hex  # names that no column of docs has
    found = repeated_strings(docs, key, text).toDF(*(f"{c}_{own}" for c in ("k", "th", "found")))
    here = docs[key].eqNullSafe(found[f"k_{own}"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == found[f"th_{own}"])
    both = docs.join(found, here, "left").select(*(docs[c] for c in docs.columns), found[f"found_{own}"])
    at, names, kinds = docs.columns.index(text), docs.columns, [f.dataType.simpleString() for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at)
            texts = column.to_pylist()
            for k, f in enumerate(b.column(len(names))):
                if f.is_valid and texts[k] is not None:
                    t = texts[k].encode()
                    texts[k] = np.frombuffer(t, dtype=np.uint8)[~_cut(t, f.as_py())].tobytes().decode("utf-8", "ignore")
            cols = [pa.array(texts, column.type) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    out = both.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in zip(names, kinds, strict=True)))
    return out.withColumn(size, F.length(text).cast(docs.schema[size].dataType)) if size and size in names else out


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))
