"""Near-duplicate classes by MinHash with tensored banding, every link confirmed on full shingle sets.

Tensoring: two collections of GROUPS short groups of minhashes are computed, and the key of table (i, j)
combines group i of the first with group j of the second. GROUPS**2 tables so need 2*GROUPS groups of
minhashes, about the square root of what separate tables would.

Steps, none of which holds a group of copies in one task or lists all pairs of a bucket:

1. One pass over the texts gives each document its number of shingles, a 128-bit identity of its shingle set and its
   signature. Documents with equal sets are one from here on (the smallest id stands for them).
2. A bucket links its members to its smallest member. Candidates whose signatures are far under the threshold go; the others
   are confirmed on the full sets, and the confirmed ones contracted to components.
3. In every bucket whose members, but for the smallest, still belong to several components, all pairs of members of different
   components are compared by signature, buckets of the same members once. So a pair that shares a bucket is compared whatever
   the smallest member of it is like.
4. Components that a candidate pair of step 2 or 3 joins without a confirmed link form a group. In a group, every member outside
   its largest component is compared with all members of other components, in blocks, by signature, then by full sets, unless
   links of the block join their components already.

A pair at the threshold s shares no table with probability 2*(1-s**2)**10, 5e-6 at 0.85 and 7e-5 at 0.8, and has signatures
under the cut of `agreeing` with at most LOST; both fall fast above the threshold.

Defined results: null and empty texts, and those of white space alone, have no shingles and are linked
with nothing; fewer words than a shingle give one shingle; texts are read whole; a row with a null
key is linked with nothing, has no component and is kept; rows that repeat a key get the same result each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import _text
from tracewell.llm._graph import components
from tracewell.llm._spark import dropped, stored, table

GROUPS, ROWS = 10, 2
HASHES = 2 * GROUPS * ROWS
#: The share of the pairs at the threshold that the comparison of signatures may lose.
LOST = 1e-5
#: Members of a group that are compared at once.
BLOCK = 2_048
#: Buckets of at most so many members are compared many at once, larger ones in blocks; the result is the same.
SMALL = 256
U64 = np.uint64
_rng = np.random.default_rng(11)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The signature of one set of distinct shingle hashes, 32 bits a hash."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4_096):
        x = (shingles[at : at + 4_096, None] ^ _B) * _A
        low = np.minimum(low, (x ^ (x >> U64(31))).min(axis=0))
    return (_text.mix(low) >> U64(32)).astype(np.uint32)


def table_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of all tables for signatures (documents x HASHES): documents x GROUPS**2."""
    g = sig.reshape(len(sig), 2, GROUPS, ROWS).astype(np.uint64)
    k = g[..., 0]
    for r in range(1, ROWS):
        k = _text.mix(k * U64(0xA0761D6478BD642F) + g[..., r])
    place = np.arange(GROUPS * GROUPS, dtype=np.uint64).reshape(GROUPS, GROUPS)
    return _text.mix(k[:, 0, :, None] * U64(0xE7037ED1A0B428DB) + k[:, 1, None, :] + place * U64(0x8EBC6AF09C88C6E3)).reshape(len(sig), -1).view(np.int64)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """k, n, s1, s2, the signature and its low bytes of rows (k, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, offs, data in _text.slices(b.column(1)):
                h, at = _text.shingle_hashes(data, offs, size)
                docs = len(offs) - 1
                n, s, sig = np.zeros(docs, np.int64), np.zeros((2, docs), np.uint64), [b""] * docs
                brief = [b""] * docs
                for d in range(docs):
                    u = np.unique(h[at[d] : at[d + 1]])
                    if n_ := len(u):
                        n[d], s[0, d], s[1, d] = n_, _text.mix(u).sum(dtype=np.uint64), _text.mix(u ^ U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                        places = minhashes(u)
                        sig[d], brief[d] = places.tobytes(), places.astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0)[row : row + docs], pa.array(n), pa.array(s[0].view(np.int64)), pa.array(s[1].view(np.int64)), pa.array(sig, pa.binary()), pa.array(brief, pa.binary())], ["k", "n", "s1", "s2", "sig", "brief"])

    return docs.mapInArrow(run, f"k {docs.schema['k'].dataType.simpleString()}, n long, s1 long, s2 long, sig binary, brief binary")


def _keys(reps: DataFrame) -> DataFrame:
    """rep, bucket: a row for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(sig)), GROUPS * GROUPS))), pa.array(table_keys(sig).ravel())], ["rep", "bucket"])

    return reps.select("rep", "sig").mapInArrow(run, f"rep {reps.schema['rep'].dataType.simpleString()}, bucket long")


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def agreeing(percent: int) -> int:
    """Signatures that agree in fewer places aren't confirmed: of the pairs at the threshold, at most LOST do."""
    p, under = percent / 100, 0.0
    for places in range(HASHES + 1):
        under += math.comb(HASHES, places) * p**places * (1 - p) ** (HASHES - places)
        if under > LOST:
            return places
    return HASHES


def _alike(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in enough of their places."""
    enough = agreeing(percent)
    kind = reps.schema["rep"].dataType.simpleString()
    side = lambda n: reps.select(F.col("rep").alias(n), F.col("sig").alias(f"s{n}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = (np.frombuffer(b"".join(x.column(c).to_pylist()), dtype=np.uint32).reshape(-1, HASHES) for c in (2, 3))
            ok = pa.array((a == b).sum(axis=1) >= enough)
            yield pa.RecordBatch.from_arrays([x.column(c).filter(ok) for c in (0, 1)], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b, ok: whether the full shingle sets of the pairs are alike enough; docs is (k, t) with a row a key."""
    kind = docs.schema["k"].dataType.simpleString()
    left = pairs.join(docs.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a")
    both = left.join(docs.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep: list[bool] = []
            for row, offs, data in _text.slices(x.column(2)):
                h, at = _text.shingle_hashes(data, offs, size)
                last, other = None, np.zeros(0, np.uint64)
                for d in range(len(offs) - 1):
                    key = x.column(1)[row + d].as_py()
                    if d == 0 or key != last:  # rows come sorted by b
                        last, t = key, np.frombuffer(x.column(3)[row + d].as_py().encode(), dtype=np.uint8)
                        other = np.unique(_text.shingle_hashes(t, np.array([0, len(t)]), size)[0])
                    keep.append(jaccard_at_least(np.unique(h[at[d] : at[d + 1]]), other, percent))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(keep, pa.bool_())], ["a", "b", "ok"])

    return both.mapInArrow(run, f"a {kind}, b {kind}, ok boolean")


def _with_sets(rows: DataFrame, size: int) -> DataFrame:
    """grp, rep, comp, sig and the shingle set (sorted 64-bit hashes) of rows (grp, rep, comp, sig, t)."""
    kind = rows.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for row, offs, data in _text.slices(x.column(4)):
                h, at = _text.shingle_hashes(data, offs, size)
                sets = [np.unique(h[at[d] : at[d + 1]]).tobytes() for d in range(len(offs) - 1)]
                yield pa.RecordBatch.from_arrays([*(x.column(c).slice(row, len(sets)) for c in range(4)), pa.array(sets, pa.binary())], ["grp", "rep", "comp", "sig", "set"])

    return rows.mapInArrow(run, f"grp {kind}, rep {kind}, comp {kind}, sig binary, set binary")


class Joined:
    """Which components are joined so far, by union-find: a further link within one joined set changes no result."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x, y) -> bool:
        """Whether x and y weren't joined before."""
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


def _in_blocks(each: DataFrame) -> DataFrame:
    """The rows (grp, rep, comp and others) with block, part and out, as _links_across wants them."""
    sizes = each.groupBy("grp", "comp").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("grp").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("all")).select("grp", F.col("m.comp").alias("main"), F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil((F.col("all") - F.col("m.n")) / BLOCK).alias("parts"))
    placed = each.join(stored(whole), "grp")
    own = lambda n: F.pmod(F.xxhash64("rep"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rest = [c for c in each.columns if c != "grp"]
    members = placed.select("grp", own("blocks").alias("block"), every("parts").alias("part"), F.lit(False).alias("out"), *rest)
    outside = placed.where("comp <> main").select("grp", every("blocks").alias("block"), own("parts").alias("part"), F.lit(True).alias("out"), *rest)
    return members.unionByName(outside)


def _alike_in_small(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join the components with members in one group whose sizes and low bytes of the signatures are near enough.

    rows: grp, comp, size, brief; all pairs in a group are compared, those at one distance in the sorted rows at a time.
    """
    kind, enough = rows.schema["comp"].dataType.simpleString(), agreeing(percent)

    def pairs(p: pa.Table) -> pa.RecordBatch:
        grp, size = p["grp"].to_numpy(), p["size"].to_numpy()
        comps = p["comp"].combine_chunks()
        comp = comps.dictionary_encode().indices.to_numpy()
        sig = np.frombuffer(b"".join(p["brief"].to_pylist()), dtype=np.uint8).reshape(-1, HASHES)
        at, found = np.arange(len(grp)), []
        for d in range(1, len(grp)):
            at = at[: np.searchsorted(at, len(grp) - d)]
            at = at[grp[at] == grp[at + d]]
            if not len(at):
                break
            u = at[(comp[at] != comp[at + d]) & (100 * np.minimum(size[at], size[at + d]) >= percent * np.maximum(size[at], size[at + d]))]
            u = u[(sig[u] == sig[u + d]).sum(axis=1) >= enough]
            found.append(np.stack([u, u + d], axis=1))
        found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        if len(found):
            found = found[np.unique(np.sort(comp[found], axis=1), axis=0, return_index=True)[1]]
            joined = Joined()
            found = found[[joined.join(x, y) for x, y in comp[found].tolist()]]
        return pa.RecordBatch.from_arrays([comps.take(pa.array(found[:, c])) for c in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for x in batches:
            if not x.num_rows:
                continue
            grp = x.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(grp, grp[-1]))  # the last group may go on in the next batch
            if cut or held and held[-1].column(0)[-1].as_py() != grp[0]:
                yield pairs(pa.Table.from_batches([*held, x.slice(0, cut)]))
                held = []
            held.append(x.slice(cut))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return rows.select("grp", "comp", "size", "brief").repartition("grp").sortWithinPartitions("grp").mapInArrow(run, f"a {kind}, b {kind}")


def _across_buckets(members: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join the components of which members share a bucket and are alike by signature; the star has judged pairs with the leader.

    members: rep, bucket, leader, size of all buckets of more than one; named: rep, comp, n, brief.
    """
    rest = members.where("size > 2 and rep <> leader").select("bucket", "rep")
    rest = stored(rest.join(named.select("rep", "comp"), "rep").distinct())
    digest = [F.sum(F.xxhash64("rep", F.lit(k)).cast("decimal(20,0)")).alias(f"d{k}") for k in (0, 1)]
    mixed = rest.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), *digest).where("lo <> hi")
    once = stored(mixed.groupBy("n", "d0", "d1").agg(F.min("bucket").alias("bucket")))
    each = rest.join(once.select("bucket", "n"), "bucket").select(F.col("bucket").alias("grp"), "rep", "comp", F.col("n").alias("many"))
    each = stored(each.join(named.select("rep", F.col("n").alias("size"), "brief"), "rep"))
    small = _alike_in_small(each.where(F.col("many") <= SMALL), percent)
    large = each.where(F.col("many") > SMALL).drop("many")
    out = small
    if not large.isEmpty():
        found = _links_across(_in_blocks(large), percent)
        comp = lambda n: named.select(F.col("rep").alias(n), F.col("comp").alias(f"c{n}"))
        out = small.unionByName(found.join(comp("a"), "a").join(comp("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    out = stored(out.distinct())
    dropped(rest, once, each)
    return out


def _links_across(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: links of outsiders to members of foreign components in a block, as many as join all components that such links join.

    rows: grp, block, part, out, rep, comp, sig, set; a place (grp, block, part) has at most BLOCK members and BLOCK outsiders.
    With size and brief in place of sig and set, a link is likeness by size and the low bytes of the signatures.
    """
    kind = rows.schema["rep"].dataType.simpleString()
    places = ["grp", "block", "part"]
    full = "set" in rows.columns
    enough = agreeing(percent)

    def across(p: pa.Table) -> Iterator[tuple]:
        out = p["out"].to_numpy(zero_copy_only=False)
        rep, comp = p["rep"].to_pylist(), np.array(p["comp"].to_pylist())
        sig = np.frombuffer(b"".join(p["sig" if full else "brief"].to_pylist()), dtype=np.uint32 if full else np.uint8).reshape(-1, HASHES)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in p["set"].to_pylist()] if full else []
        inside = np.flatnonzero(~out)
        sizes = np.array([len(x) for x in sets]) if full else p["size"].to_numpy()
        joined = Joined()
        for u in np.flatnonzero(out):
            near = (sig[inside] == sig[u]).sum(axis=1) >= enough
            near &= (comp[inside] != comp[u]) & (100 * np.minimum(sizes[inside], sizes[u]) >= percent * np.maximum(sizes[inside], sizes[u]))
            for v in inside[near]:
                if joined.root(comp[u]) != joined.root(comp[v]) and (not full or jaccard_at_least(sets[u], sets[v], percent)):
                    joined.join(comp[u], comp[v])
                    yield max(rep[u], rep[v]), min(rep[u], rep[v])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            found = [*across(pa.Table.from_batches(held))]
            of = held[0].schema.field("rep").type
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], of), pa.array([x[1] for x in found], of)], ["a", "b"])

        for x in batches:
            place = [x.column(c).to_pylist() for c in range(3)]
            now = [*zip(*place, strict=True)]
            cuts = [0, *(i for i in range(1, len(now)) if now[i] != now[i - 1]), len(now)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if held and tuple(held[-1].column(c)[-1].as_py() for c in range(3)) != now[s]:
                    yield done()
                    held = []
                held.append(x.slice(s, e - s))
        if held:
            yield done()

    ordered = rows.select(*places, "out", "rep", "comp", *(("sig", "set") if full else ("size", "brief"))).repartition(*places).sortWithinPartitions(*places)
    return ordered.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", *, size: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links) and kept of every row.

    Links are pairs with 100 * intersection >= percent * union of their sets of size-word shingles.
    """
    plain = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    signed = stored(_signed(plain, size))
    named = signed.where("n > 0 and k is not null")
    reps = stored(named.groupBy("s1", "s2").agg(F.min(F.struct("k", "sig", "n", "brief")).alias("m")).select("s1", "s2", F.col("m.k").alias("rep"), "m.sig", "m.n", "m.brief"))
    keys = _keys(reps)
    buckets = keys.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).where("size > 1")
    members = stored(keys.join(buckets, "bucket"))
    pairs = stored(members.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct())
    near = stored(_alike(pairs, reps, percent))
    dropped(pairs)
    # Only the texts of documents in a candidate pair are moved again.
    wanted = near.select(F.col("a").alias("k")).unionByName(near.select(F.col("b").alias("k"))).distinct()
    # What is wanted grows with the input, so it isn't broadcast at any size.
    found = plain.where("k is not null and t is not null").join(wanted.hint("merge"), "k", "left_semi")
    texts = stored(found.dropDuplicates(["k"]) if _repeats(named) else found)
    links = stored(confirmed(near, texts, size, percent).where("ok").select("a", "b"))
    comp = stored(components(links))
    named_comp = reps.join(comp, F.col("rep") == F.col("node"), "left").select("rep", "sig", "n", "brief", F.coalesce("component", "rep").alias("comp"))
    of = lambda n: named_comp.select(F.col("rep").alias(n), F.col("comp").alias(f"c{n}"))
    foreign = near.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    beside = _across_buckets(members, named_comp, percent)
    dropped(members)
    foreign = stored(foreign.unionByName(beside).distinct())
    if not foreign.isEmpty():
        groups = stored(components(foreign).select(F.col("node").alias("comp"), F.col("component").alias("grp")))
        grouped = stored(named_comp.join(groups, "comp").select("grp", "rep", "comp", "sig"))
        unread = grouped.select(F.col("rep").alias("k")).join(texts.select("k"), "k", "left_anti").distinct()
        others = plain.where("k is not null and t is not null").join(unread.hint("merge"), "k", "left_semi").dropDuplicates(["k"])
        inside = stored(_with_sets(grouped.join(texts.unionByName(others), F.col("rep") == F.col("k")).select("grp", "rep", "comp", "sig", "t"), size))
        more = stored(_links_across(_in_blocks(inside), percent))
        comp = stored(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
        dropped(inside)
    dropped(near, texts)
    sets = reps.join(comp, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "rep").alias("c"))
    own_set = signed.join(sets, ["s1", "s2"], "left")
    c = F.when((F.col("n") > 0) & F.col("k").isNotNull(), F.col("c")).otherwise(F.col("k"))
    return own_set.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), c.alias("component_id"), F.coalesce(c == F.col("k"), F.lit(True)).alias("kept"))


def _repeats(named: DataFrame) -> bool:
    """Whether a key is on several rows."""
    r = named.agg(F.count("*"), F.approx_count_distinct("k", 0.01)).first()
    return r[0] > 0 and named.groupBy("k").count().where("count > 1").limit(1).count() > 0


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each class of near-duplicates: the one with the smallest key (one of those that repeat it)."""
    gone = near_duplicates(docs, key, text, **options).where(~F.col("kept")).select(key).distinct()
    once = docs.where(F.col(key).isNotNull()).join(gone, key, "left_anti").dropDuplicates([key])
    return once.unionByName(docs.where(F.col(key).isNull())).select(docs.columns)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
