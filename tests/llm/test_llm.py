"""The operators of the llm subpackage against brute force, on small tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import _text, decontaminate, language_id, mixing, near_dedup, quality, quality_rules, suffix_dedup, token_counts, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "ba do ke li mu na po ri su ta ve wo zi ex or".split()


def prose(rng, words, style=SYLLABLES):
    return " ".join("".join(rng.choice(style) for _ in range(rng.randint(1, 4))) for _ in range(words))


def docs_of(spark, texts, lang="en", source="s"):
    rows = [(k, t, lang, source, None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(3)


def odd_texts(rng):
    """Nulls, empties, ties, repeats, blanks, very long and odd ones."""
    long = prose(rng, 30_000)
    return [None, "", " \t\n", "a", "a", "one two", "ééé ñ 中文 😀", "\x1c\x1f x", long, long, "x" * 5_000, "word " * 3_000, "line\n" * 50, "\x00\x01", "the end. " * 30]


def empty(spark):
    return spark.createDataFrame([], DOC)


def clashing(df):
    """Extra columns whose names operators might use inside."""
    extra = ["k", "t", "h", "g", "th", "n", "pos", "words", "found", "rep", "comp", "score", "bucket", "a", "b", "host", "ws", "l", "gl", "gs", "d2", "_found", "probability", "weight", "_tokens", "_s", "_l", "_t", "_weight", "_topic", "_probability", "_sampled", "source_", "topic", "tokens", "luck", "c0", "c1", "sampled", "item", "ipos", "values", "parts", "all", "key", "rich", "at", "y", "v"]
    return df.select("*", *(F.lit(7).alias(c) for c in extra if c not in df.columns))


# 1 ------------------------------------------------------------------------------------------------------------------


def brute_cut(texts, size):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + size] for t in raw for i in range(len(t) - size + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = True
        out.append(gone)
    return raw, out


def shared_texts(rng, n=60):
    passages = [prose(rng, k) for k in (20, 40, 80, 200)]
    texts = []
    for k in range(n):
        t = prose(rng, rng.randint(0, 120))
        for p in rng.sample(passages, rng.randint(0, 3)):
            cut = rng.randint(0, len(p) // 2)
            t += " " + p[cut : cut + rng.randint(150, 600)] + " " + prose(rng, rng.randint(0, 60))
        texts.append(t)
    return texts + texts[:7] + [texts[3][:-3] + "zzz", "ab" * 400, "q" * 900, "é" * 300 + texts[5]]


@pytest.mark.parametrize(("seed", "bucket"), [(1, None), (2, None), (3, 1)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, seed, bucket):
    if bucket is not None:
        monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)  # every bucket is hot
    rng = random.Random(seed)
    texts = shared_texts(rng) + odd_texts(rng)[:8]
    got = {r.doc_id: r for r in suffix_dedup.dedup_report(clashing(docs_of(spark, texts))).collect()}
    raw, gone = brute_cut(texts, 200)
    for k, (t, g) in enumerate(zip(raw, gone, strict=True)):
        spans = int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~g])
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(t), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()), k
    assert any(g.any() and not g.all() for g in gone)


def test_suffix_dedup_edge_cases(spark):
    rng = random.Random(4)
    assert suffix_dedup.dedup_report(empty(spark)).collect() == []
    t = prose(rng, 90)
    same = spark.createDataFrame([(1, t), (1, t), (None, t + "x"), (None, None), (1, "short")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_report(same).collect()), key=str)
    n = len(t)
    assert rows == sorted([(1, n, n), (1, n, n), (None, n + 1, n), (None, 0, 0), (1, 5, 0)], key=str)
    cut = suffix_dedup.remove_repeats(clashing(docs_of(spark, [t + " one", t + " two", "three", None])), size="n_chars")
    left = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert left == {0: ("one", 3), 1: ("two", 3), 2: ("three", 5), 3: (None, None)}


def test_long_documents_are_searched_in_pieces(monkeypatch):
    rng = random.Random(5)
    t = np.frombuffer((prose(rng, 4_000) + "z" * 700).encode(), np.uint8)
    whole = suffix_dedup.anchors(t, np.array([0, len(t)]))
    monkeypatch.setattr(suffix_dedup, "PIECE", 1_000)
    parts = suffix_dedup.anchors(t, np.array([0, len(t)]))
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_the_cover_is_perfect():
    d = {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert d == set(range(suffix_dedup.PERIOD))


# 3 ------------------------------------------------------------------------------------------------------------------


def brute_near(texts, size, percent):
    sets = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = [*range(len(texts))]

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return [(len(s), root(k)) for k, s in enumerate(sets)]


def near_texts(rng):
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randint(3, 300)).split()
        for _ in range(rng.randint(1, 9)):
            w = [*base]
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = prose(rng, 1)
            texts.append(" ".join(w).replace("ba", "BA") if rng.random() < 0.2 else "\t".join(w))
    chain = prose(rng, 120).split()
    for k in range(25):  # each near the next, the ends far apart
        chain = [*chain[3:], *prose(rng, 3).split()]
        texts.append(" ".join(chain))
    return texts


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 3, 85), (2, 5, 80), (3, 3, 85)])
def test_near_duplicates_equal_brute_force(spark, seed, size, percent):
    rng = random.Random(seed)
    texts = near_texts(rng) + odd_texts(rng)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(clashing(docs_of(spark, texts)), size=size, percent=percent).collect()}
    for k, (n, root) in enumerate(brute_near(texts, size, percent)):
        assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (n, root, root == k), k


@pytest.mark.parametrize("small", [256, 0])
def test_a_pair_hidden_by_other_leaders_is_found(spark, monkeypatch, small):
    """In each of the 100 buckets that the pair shares, a document unlike both has the smallest id."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    a = [f"w{k}" for k in range(200)]
    hashes = lambda words: _text.shingle_hashes(t := np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(t)]), 1)[0]
    each = np.array([near_dedup.minhashes(hashes([w])) for w in a])
    top = near_dedup.minhashes(hashes(a))
    first = [[a[np.flatnonzero(each[:, c] == top[c])[0]] for c in range(near_dedup.ROWS * g, near_dedup.ROWS * (g + 1))] for g in range(2 * near_dedup.GROUPS)]
    leaders = [" ".join(dict.fromkeys(x + y)) for x in first[: near_dedup.GROUPS] for y in first[near_dedup.GROUPS :]]
    texts = [*leaders, " ".join(a), " ".join(a + ["more", "words"])]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs_of(spark, texts), size=1, percent=85).collect()}
    assert [got[k] for k in range(len(texts))] == [root for _, root in brute_near(texts, 1, 85)] and got[101] == 100


def test_near_duplicates_edge_cases(spark):
    assert near_dedup.near_duplicates(empty(spark)).collect() == []
    df = spark.createDataFrame([(2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, None)], "doc_id long, text string")
    rows = sorted(map(tuple, near_dedup.near_duplicates(df).collect()), key=str)
    assert rows == sorted([(2, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (3, 0, 3, True)], key=str)
    kept = near_dedup.keep_one(df)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c d e f"), (None, "a b c d e f"), (3, None)], key=str)


def test_tables_are_tensored():
    sig = np.random.default_rng(0).integers(0, 1 << 32, (2, near_dedup.HASHES), dtype=np.uint32)
    sig[1] = sig[0]
    sig[1, 2:20] += 1  # the first collection agrees in its first group only
    keys = near_dedup.table_keys(sig).reshape(2, near_dedup.GROUPS, near_dedup.GROUPS)
    assert (keys[0, 0] == keys[1, 0]).all() and not (keys[0, 1:] == keys[1, 1:]).any()


# 5 ------------------------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    t = token_counts.tokenizer(None, "byte_bpe_50k.json")
    rng = random.Random(1)
    alphabet = [chr(c) for c in [*range(0, 0x250), 0x3B1, 0x4E2D, 0x1F600, 0x2003, 0x301]]
    texts = odd_texts(rng) + ["x <|endoftext|> y", "<|endoftext|", "I'll we've 12345 ½²", "  lead  and   trail  \n\n \t"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    got = {r.doc_id: r for r in token_counts.count_tokens(clashing(docs_of(spark, texts)), limit=20).collect()}
    for k, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((x or "").encode()), n, n > 20), x
    assert token_counts.count_tokens(empty(spark)).collect() == []


def test_every_character_is_split_alike():
    """Of all scripts; the few whose class isn't settled are left to the library."""
    c, unsettled = token_counts.Counter({}), token_counts._unsettled()
    some = [chr(x) for x in range(0x250, 0x30000) if not 0xD800 <= x < 0xE000 and not unsettled(chr(x))]
    assert len(some) > 100_000 and not any(map(unsettled, "’“—…–😀中α"))
    for k, x in enumerate(some):
        y = some[k * 7919 % len(some)]
        s = f"a{x}b {x}{y} x1{x}2{y} {x}a \n{x}{x}'s"
        assert c.pre_tokens(s) is not None and c.count(s) == c._encode(s), hex(ord(x))


def test_every_plain_character_is_split_alike():
    c = token_counts.Counter({})
    for cp in range(0x250):
        x = chr(cp)
        for s in (f"a{x}b", f" {x}{x} x", f"1{x}2", f"{x} {x}", f"a \n{x}", f"{x}'s"):
            assert c.count(s) == c._encode(s), hex(cp)


# 10, 6, 2 -----------------------------------------------------------------------------------------------------------

TONGUES = {"xx": "ba do ke li mu".split(), "yy": "schu pfen ich und lich".split(), "zz": "eau tre ille oux é".split()}


def tongue_docs(spark, n=90):
    rng = random.Random(2)
    rows = [(k, prose(rng, rng.randint(5, 60), TONGUES[lang]), lang, "s", 0) for k in range(n) for lang in [["xx", "yy", "zz"][k % 3]]]
    return spark.createDataFrame(rows, DOC)


def test_language_id(spark):
    train = tongue_docs(spark)
    odd = docs_of(spark, odd_texts(random.Random(3)) + ["123 456 !?"], lang=None).withColumn("doc_id", F.col("doc_id") + 1000)
    got = {r.doc_id: r for r in language_id.identify(clashing(train.unionByName(odd)), learn_from=~language_id.held_out("doc_id", 4, 2)).collect()}
    assert all(got[r.doc_id].lang_pred == r.lang and 0 <= got[r.doc_id].score <= 1 for r in train.collect())
    for k, t in enumerate(odd_texts(random.Random(3)) + ["123 456 !?"]):
        assert (got[1000 + k].lang_pred == "und") == (not any(c.isalpha() for c in t or "")), t
    assert {r.lang_pred for r in language_id.identify(docs_of(spark, ["abc"], lang=None)).collect()} == {"und"}
    assert language_id.identify(empty(spark)).collect() == []
    kept = language_id.keep_identified(clashing(train.unionByName(odd.where("doc_id < 1003"))))
    assert kept.count() == train.count() and "k" in kept.columns


def test_language_scores_equal_bayes(spark):
    """Direct multinomial Bayes on dictionaries of n-grams, for a batch of texts and for each alone."""
    rng = random.Random(14)
    logp = np.log(np.random.default_rng(2).random((3, language_id.BUCKETS + 1)) + 0.1).astype(np.float32)
    texts = ["", "12 3", "a", "é", "İstanbul ΣΑΣ", "a\0b", "\0", "x" * 2_000, *[t or "" for t in odd_texts(rng)[:11]], *[prose(rng, rng.randint(1, 90)) for _ in range(40)]]
    got = language_id.score_batch(texts, logp)
    for t, row in zip(texts, got, strict=True):
        words = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ")
        words = " " + " ".join(words.split()) + " " if words.strip() else ""
        if not words:
            assert np.isnan(row).all(), t
            continue
        c = np.array([ord(x) for x in words], dtype=np.uint64)
        want = logp[:, -1].astype(float)
        for n in language_id.SIZES:
            for g, times in collections.Counter(language_id.grams(c, n).tolist()).items():
                want = want + times * logp[:, g].astype(float)
        assert np.allclose(row, want, rtol=1e-4), t
        assert np.allclose(row, language_id.score_text(t, logp), rtol=1e-6)


def test_a_long_text_scores_like_its_parts(monkeypatch):
    logp = np.log(np.random.default_rng(1).random((2, language_id.BUCKETS + 1)) + 0.1).astype(np.float32)
    t = prose(random.Random(1), 3_000)
    whole = language_id.score_text(t, logp)
    monkeypatch.setattr(language_id, "SLICE_CHARS", 777)
    assert np.allclose(whole, language_id.score_text(t, logp))


def test_the_language_stage_learns_from_every_document(spark, monkeypatch):
    """More documents of a language than the former sample had: the n-grams of all of them are in the model."""
    models, fit = [], language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda *args: models.append(fit(*args)) or models[-1])
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "ab").otherwise("c d").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(3).alias("n_chars"))
    assert corpus_pipeline.identified(spark, docs, "").count() == 9_000
    want = np.full(language_id.BUCKETS, 0.5)
    for text, n in (("ab", 3_000), ("c d", 6_000)):
        for size in language_id.SIZES:
            want += n * np.bincount(language_id.grams(language_id.folded(text), size), minlength=language_id.BUCKETS)
    [(langs, logp)] = models
    assert langs == ["en"] and np.allclose(logp[0, :-1], np.log(want / want.sum()), rtol=1e-5)


def test_grams_of_many_texts_are_those_of_each(monkeypatch):
    monkeypatch.setattr(language_id, "SLICE_CHARS", 777)
    texts = ["", "12 3", "é", "a\0b", "\0", *[t or "" for t in odd_texts(random.Random(4))]]
    want = sum(np.bincount(language_id.grams(language_id.folded(t), n), minlength=language_id.BUCKETS) for t in texts for n in language_id.SIZES)
    assert (language_id.gram_counts(texts) == want).all()


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["vilewordo", "nastyterm", "slurrish"]
    rows, labels = [], []
    for k in range(240):
        toxic = k % 3 == 0
        w = prose(rng, 60).split()
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((k, " ".join(w), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    for k, t in enumerate(["a VILEWORDO b", "a v1l3w0rd0 b", "a vіlеwordо b", "na\u200bstyterm", "vile wordo", None, ""]):
        rows.append((1000 + k, t, "en", "s", 0))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = language_id.held_out("doc_id", 5, 0)
    got = {r.doc_id: r for r in toxicity.toxicity(clashing(spark.createDataFrame(rows, DOC)), lab, learn_from=~out).collect()}
    assert all(got[k].predicted == t for k, _, t in labels)
    assert [got[1000 + k].predicted for k in range(7)] == [1, 1, 1, 1, 0, 0, 0]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    none = toxicity.toxicity(spark.createDataFrame(rows, DOC), lab.limit(0))
    assert {r.predicted for r in none.collect()} == {0}
    assert toxicity.toxicity(empty(spark), lab).collect() == []


def test_exception_phrases_cancel_their_terms(spark):
    texts = [f"{prose(random.Random(k), 20)} trash {prose(random.Random(k + 99), 20)}" for k in range(40)] + [prose(random.Random(k + 500), 40) for k in range(40)]
    lex = toxicity.learn(spark.createDataFrame([(t, int(k < 40)) for k, t in enumerate(texts)], "t string, y int"), ("trash can",))
    assert lex.weight("so much trash here") > 0 and lex.weight("a trash can here") == 0


def test_quality(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for k in range(300):
        t = prose(rng, rng.randint(20, 120))
        junk = k % 5 == 0
        if junk:
            t = rng.choice([lambda x: "!! ".join(x.upper().split()), lambda x: "*** ".join(x.split()), lambda x: f"{x.split()[0]} " * 60, lambda x: " | ".join(x.split())])(t)
        rows.append((k, t, "en", "s", 0))
        labels.append((k, int(not junk), 0))
    rows += [(1000 + k, t, "en", "s", 0) for k, t in enumerate(odd_texts(rng))]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(clashing(spark.createDataFrame(rows, DOC)), lab, learn_from=~language_id.held_out("doc_id", 3, 1)).collect()}
    assert np.mean([got[k].predicted == q for k, q, _ in labels]) > 0.98
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert quality.quality(empty(spark), lab).collect() == []
    assert {r.score for r in quality.quality(docs_of(spark, ["a"]), lab.limit(0)).collect()} == {0.5}


def brute_features(t):
    """The statistics of one text on plain lists; words are of bytes."""
    raw = (t or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not raw:
        return [0.0] * len(quality.FEATURES)
    count = lambda chars: sum(raw.count(bytes([c])) for c in set(chars))
    n, size = max(len(words), 1), len(raw)
    upper = sum(65 <= c <= 90 for c in raw)
    lower = sum(97 <= c <= 122 or c >= 128 for c in raw)
    folded = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    three = [tuple(folded[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [tuple(folded)] if words else []
    again = lambda x: len(x) - len(set(x))
    odd = set(b"#*$%&<>=~^_{}[]\\@!?")
    return [
        np.log1p(len(words)), np.log1p(sum(map(len, words)) / n), upper / max(upper + lower, 1), count(b"#*$%&<>=~^_{}[]\\@") / size, count(b"!?") / size, count(b"0123456789") / size, count(b"|") / size,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, again(words) / n, again(three) / max(len(three), 1), sum(w[-1] in odd for w in words) / n,
        sum(len(w) > 2 and 65 <= w[0] <= 90 and 65 <= w[1] <= 90 for w in words) / n, np.log1p(len(words) / (raw.count(b"\n") + 1)),
    ]


def test_quality_features_equal_brute_force():
    rng = random.Random(16)
    texts = ["", *[t for t in odd_texts(rng) if t], "ABC Abc abc! x# 12|3 a a a\n\nÉé", *[prose(rng, rng.randint(1, 80)).title() for _ in range(20)]]
    data = [t.encode() for t in texts]
    got = quality.features(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([*map(len, data)]))))
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, brute_features(t)), t[:60]


def test_preferences_are_learned_as_by_plain_descent():
    """The weights minimise the logistic loss of the differences: its gradient, on the same pairs, is nil."""
    rng = np.random.default_rng(4)
    y = (rng.random(400) < 0.6).astype(int)
    x = rng.normal(size=(400, 3)) + y[:, None] * np.array([1.0, -0.5, 0.0])
    w, cut = quality.fit(x, y, pairs=5_000)
    draw = np.random.default_rng(7)
    diff = (x[draw.choice(np.flatnonzero(y == 1), 5_000)] - x[draw.choice(np.flatnonzero(y != 1), 5_000)]) / x.std(axis=0)
    v = w * x.std(axis=0)
    assert np.allclose(diff.T @ (1 / (1 + np.exp(diff @ v))) / 5_000, 1e-2 * v, atol=1e-6)
    assert w[0] > 0 > w[1] and np.mean((x @ w >= cut) == (y == 1)) > 0.7


def test_preferences_of_all_pairs_equal_brute_force(spark):
    """The gradient over every pair of labelled rows, with no row left out, is nil; the threshold is as good as any."""
    rng = np.random.default_rng(6)
    y = rng.random(900) < 0.4
    x = rng.normal(size=(900, len(quality.FEATURES))) * 3 + y[:, None] * rng.normal(size=len(quality.FEATURES))
    x[::100] *= 30  # a few far out
    rows = spark.createDataFrame([(bool(a), *map(float, b)) for a, b in zip(y, x, strict=True)], "good boolean, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    w, cut = quality.learned(rows)
    again = quality.learned(rows.repartition(5))
    assert np.allclose(w, again[0], rtol=1e-6) and np.isclose(cut, again[1], rtol=1e-6)
    scale = x.std(axis=0)
    diff = ((x[y][:, None] - x[~y][None]) / scale).reshape(-1, x.shape[1])
    v = w * scale
    assert np.allclose(diff.T @ (1 / (1 + np.exp(diff @ v))) / len(diff), 1e-2 * v, atol=1e-4)
    own = x @ w
    wrong = lambda c: np.mean(own[y] < c) + np.mean(own[~y] >= c)
    assert wrong(cut) < min(map(wrong, own)) + 3e-3


def test_every_label_counts_for_quality(spark, monkeypatch):
    """More labels than any bound on the rows learned from: all of them reach the fit."""
    seen, fitted = [], quality.learned
    monkeypatch.setattr(quality, "learned", lambda rows: seen.append(rows.groupBy("good").count().collect()) or fitted(rows))
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"))
    quality.quality(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    assert sorted(tuple(r) for r in seen[0]) == [(False, 15_000), (True, 15_000)]


def test_toxic_weights_equal_brute_force():
    rng = random.Random(17)
    terms = {" vile": 3.0, " nasty": 2.5, " slur": 4.0}
    lex = toxicity.Lexicon(terms, {" vile bin ": -3.0}, 0.1)
    for _ in range(200):
        t = " ".join(rng.choice(["vile", "VILEST", "n4sty", "sIur", "bin", "ok", "évile", "vile-bin", "x", "1", "…"]) for _ in range(rng.randint(0, 30)))
        folded = toxicity.fold(t)
        want = sum(w * len(re.findall(f"(?={re.escape(k)})", folded)) for k, w in {**lex.terms, **lex.exceptions}.items())
        assert np.isclose(lex.weight(t), max(want, 0) / max(1, len(folded.split()))), t
    assert lex.weight("a vile bin") == 0 and lex.weight("nasty " * 50_000) > 2.4


def test_lexicon_equals_brute_force(spark, monkeypatch):
    """Terms, neighbours, phrases and threshold against counts in plain Python; with tasks that pass counts on early, too."""
    rng = random.Random(27)
    stems = ["vileword", "vilewagon", "nast", "slurrish", "scumbagger"]
    rows = []
    for k in range(160):
        w = prose(rng, 40).split()
        for _ in range(4):
            w.insert(rng.randrange(len(w)), rng.choice(stems) + rng.choice(["", "a", "o"]) if k % 2 else rng.choice(["vilemoss", "kind nastier", "ok"]))
        rows.append((" ".join(w), k % 2))
    rows += [("copied " + "onceonlyword " * 9, 1)] * 6 + [(None, 1), ("", 0), ("x" * 3_000 + " slurrish", 0)]
    words = [(toxicity.fold(t).split(), y) for t, y in rows]
    n = collections.Counter(y for _, y in words)
    df, prev, pairs = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for ws, y in words:
        df.update({(w[:k], y) for w in ws for k in range(4, 9) if len(w) >= k})
        for a, w in zip(["", *ws], ws, strict=False):
            for k in range(4, 9):
                if y and len(w) >= k:
                    prev[w[:k]].add(a)
        pairs.update({(x, y) for x in zip(ws, ws[1:], strict=False)} | {((w,), y) for w in ws[:1] + ws[-1:]})
    odds = {x: np.log((a + 0.5) / (n[1] + 1)) - np.log((df[x, 0] + 0.5) / (n[0] + 1)) - (1 / (a + 0.5) + 1 / (df[x, 0] + 0.5)) ** 0.5 for (x, y), a in [*df.items()] if y and a >= 4}
    odds = {x: w for x, w in odds.items() if w >= toxicity.MIN_ODDS and len(prev[x]) >= max(4, min(df[x, 1], 40) / 2)}
    counts = lambda x: (df[x, 1], df[x, 0])
    odds = {x: w for x, w in odds.items() if not any(y[:-1] == x and counts(y) == counts(x) for y in odds)}
    longest = lambda w: max(((len(x), o) for x, o in odds.items() if w.startswith(x)), default=(0, 0.0))[1]
    clean = {p for (p, y), c in pairs.items() if not y and c >= 4 and len(p) == 2 and pairs[p, 1] * n[0] < c * n[1] / 4 and any(map(longest, p))}
    for entries in (200_000, 10):
        monkeypatch.setattr(toxicity, "ENTRIES", entries)
        lex = toxicity.learn(spark.createDataFrame(rows, "t string, y int").repartition(3))
        assert {x[1:] for x in lex.terms} == odds.keys() and len(odds) >= 3 and "onceonly" not in odds
        for x in [*odds, *stems, "vilemoss"]:
            assert np.isclose(sum(lex.terms.get(f" {x[:k]}", 0.0) for k in range(4, 9) if len(x) >= k), longest(x))
        assert clean <= {tuple(p.split()) for p in lex.exceptions}
        x = np.array([lex.weight(t) for t, _ in rows])
        y = np.array([y == 1 for _, y in rows])
        rate = lambda c: (x[y] >= c).mean() + (x[~y] < c).mean()
        assert np.isclose(rate(lex.threshold), max(rate(c) for c in [*(x + 1e-9), *(x - 1e-9)]))


def test_scores_of_repeated_rows_are_equal(spark):
    rng = random.Random(18)
    texts = [prose(rng, 40) for _ in range(30)]
    docs = docs_of(spark, texts)
    twice = docs.unionByName(docs)
    lab = spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(30)], "doc_id long, quality int, toxic int")
    for f in (lambda d: quality.quality(d, lab), lambda d: toxicity.toxicity(d, lab), lambda d: language_id.identify(d), lambda d: token_counts.count_tokens(d), lambda d: quality_rules.judged(d)):
        rows = collections.Counter(map(tuple, f(twice).collect()))
        assert len(rows) == 30 and set(rows.values()) == {2}


# 9 ------------------------------------------------------------------------------------------------------------------


def brute_counts(t):
    w = WORD.findall(t or "")
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)


def test_quality_rules(spark):
    rng = random.Random(8)
    texts = odd_texts(rng) + [prose(rng, rng.randint(50, 200)) for _ in range(150)] + ["#$% ".join(prose(rng, 80).split())] + [prose(rng, 60) + "\n" + "same line here now\n" * 9, "x y z " * 40 + prose(rng, 100)]
    got = {r.doc_id: r for r in quality_rules.judged(clashing(docs_of(spark, texts, source=None))).collect()}
    for k, t in enumerate(texts):
        want = brute_counts(t)
        assert (got[k].n_words, got[k].word_chars, got[k].n_symbols, got[k].n_dup_lines, got[k].n_repeat_words) == want, k
        assert got[k].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[k].base_failed and got[k].kept)
    plain = range(15, 165)
    assert all(got[k].kept for k in plain) and not got[165].kept
    assert quality_rules.judged(empty(spark)).collect() == []


def numpy_mcd(x, starts):
    """Concentration from many starts to the end, on sorted exact distances: the smallest determinant found."""
    floor = np.array([quality_rules.VECTOR[v] ** 2 for v in quality_rules.NAMES])
    h = int(np.ceil(len(x) * quality_rules.HALF))
    best = None
    for chosen in starts:
        last = np.inf
        for _ in range(60):
            mean = chosen.mean(axis=0)
            cov = np.cov(chosen.T, bias=True)
            np.fill_diagonal(cov, np.maximum(np.diag(cov), floor))
            size = np.linalg.slogdet(cov)[1]
            if len(chosen) == h and (best is None or size < best[0]):
                best = size, mean, cov
            if len(chosen) == h and size >= last - 1e-12:
                break
            last = size if len(chosen) == h else np.inf
            d2 = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(axis=1)
            chosen = x[np.argsort(d2, kind="stable")[:h]]
    return best


@pytest.mark.parametrize("kind", ["cluster", "spread", "clean"])
def test_robust_estimates_find_the_minimum(spark, kind):
    """Against numpy from 200 random starts, on samples with outliers at one place, all around, and without."""
    rng = np.random.default_rng(3)
    d = quality_rules.D
    a = rng.normal(size=(d, d)) / 2 + 2 * np.eye(d)
    x = rng.normal(size=(1200, d)) @ a.T + np.arange(d)
    if kind != "clean":
        x[:200] = rng.normal(size=(200, d)) * (0.3 if kind == "cluster" else 40) + 14
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"{v} double" for v in quality_rules.NAMES))
    m = quality_rules.estimates(rows, True).first()
    size, mean, cov = numpy_mcd(x, [x[rng.choice(len(x), 30, replace=False)] for _ in range(200)])
    got = np.array([m[f"m_{i}"] for i in range(d)])
    low = np.array([[m[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(d)] for i in range(d)])
    d2 = (np.linalg.solve(low, (x - got).T) ** 2).sum(axis=0)
    assert np.isclose(np.median(d2), quality_rules.MEDIAN_5, rtol=0.05) or np.median(d2) < quality_rules.MEDIAN_5
    near = x[np.argsort(d2, kind="stable")[: int(np.ceil(len(x) * quality_rules.HALF))]]
    own = np.cov(near.T, bias=True)
    assert np.linalg.slogdet(own)[1] < size + 0.05  # of the determinant's logarithm; bins make it not exact
    assert np.abs(got - mean).max() < 0.15 and (kind == "clean" or (d2[:200] > quality_rules.CUT).mean() > 0.95)


# 7 ------------------------------------------------------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(9)
    items = [prose(rng, 30), "A train leaves Berlin at 60 km per hour and reaches Paris after 7 hours, how far did the train from Berlin go", prose(rng, 5), "a b", None, "Mia has 3 apples and 3 pears, so how many more than 4 plums has she got in her basket"]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    texts = [
        prose(rng, 40) + " " + items[0] + " " + prose(rng, 40),
        "x y " + items[1].replace("60", "85").replace("7", "9").replace("Berlin", "Madrid"),
        items[1].replace("from Berlin", "from Madrid"),  # one slot, two values
        prose(rng, 200),
        "w " + items[2] + " z",
        items[5].replace("3", "8", 1).replace("3", "5", 1),  # the same slot twice, with two values
        items[0].upper(),
        None,
        "",
        "1 2 3 4 5 6 7 8 9 10 11 12",
    ]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(clashing(docs_of(spark, texts)), bench).collect()}
    assert (0, 0) in got and got[0, 0].exact and got[0, 0].n_matched == got[0, 0].n_windows == 23
    assert (1, 1) in got and not got[1, 1].exact
    assert (4, 2) in got and (6, 0) in got
    assert not {k for k in got if k[0] in (3, 7, 8, 9)}
    assert (5, 5) not in got or not got[5, 5].exact
    left = decontaminate.without_leaks(docs_of(spark, texts), bench)
    assert {r.doc_id for r in left.collect()} == {*range(10)} - {k[0] for k in got}
    assert decontaminate.leaks(empty(spark), bench).collect() == []
    assert decontaminate.leaks(docs_of(spark, texts), bench.limit(0)).collect() == []


def test_leaks_with_coinciding_numbers_few_words_or_long_items(spark):
    rng = random.Random(12)
    long = prose(rng, 2_000)
    items = ["a box has 3 red and 3 blue balls, how many balls are in the box", "Compute 12 + 34 - 56 * 78 / 9", long, "zyx wvu 17", "then the road from Berlin goes on and on until Berlin is far behind us all and nothing but the open fields lies there in the sun"]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    texts = [items[0].replace("3", "5", 1).replace("3", "7"), f"x {items[1]} y", "Compute 12 + 34 - 56 * 78 / 8", prose(rng, 50) + " " + " ".join(long.split()[700:800]), "so zyx wvu 17 is", "so zyx wvu 18 is", items[4].replace("Berlin", "Madrid", 1)]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs_of(spark, texts), bench).collect()}
    assert {*got} == {(0, 0), (1, 1), (3, 2), (4, 3), (6, 4)}
    assert [k for k, r in sorted(got.items()) if r.exact] == [(1, 1), (3, 2), (4, 3)] and got[3, 2].n_matched == 93


# Brute force, on plain lists.


def brute_template(text):
    out = []
    for x in regex.findall(r"[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*|[%[\p{N}--[0-9]]]+", text or "", flags=regex.V1):
        if x[0] in "0123456789":
            out.append("\x01" + x)
        elif out and out[-1][0] == "\x01" and x.lower() in decontaminate.UNITS:
            out.append("\x02" + x.lower())
        else:
            out.append(("\x03" if regex.match(r"\p{Lu}\p{Ll}", x) else "") + x.lower())
    return out


def brute_leaks(texts, items):
    found = {}
    for j, item in enumerate(items):
        own = brute_template(item)
        size = min(len(own), decontaminate.WINDOW)
        if not size:
            continue
        shape = lambda w: tuple(x[0] if x[0] < "\x04" else x for x in w)
        rich = lambda w: sum(x[0] >= "\x04" for x in w) >= decontaminate.WORDS
        mine = [own[i : i + size] for i in range(len(own) - size + 1)]
        for d, t in enumerate(texts):
            ws = brute_template(t)
            hits = []  # (ipos, shift, item's window, document's window)
            for p in range(len(ws) - size + 1):
                w = ws[p : p + size]
                hits += [(i, p - i, m, w) for i, m in enumerate(mine) if (shape(m) == shape(w) if rich(m) else m == w)]
            pairs = collections.defaultdict(set)
            for _, shift, m, w in hits:
                if rich(m):
                    for x, y in zip(m, w, strict=True):
                        if x[0] < "\x04":
                            pairs[shift, x].add(y)
            torn = {k for k, v in pairs.items() if k[1][0] != "\x01" and len(v) > 1}
            left = [h for h in hits if not rich(h[2]) or not any((h[1], x) in torn for x in h[2])]
            n, n_rich = len({h[0] for h in left}), len({h[0] for h in left if rich(h[2])})
            all_rich = sum(map(rich, mine))
            if left and (n >= min(len(mine) * decontaminate.SHARE, decontaminate.ENOUGH) or n_rich and n_rich >= all_rich * decontaminate.SHARE):
                exact = all(v == {k[1]} for k, v in pairs.items() if k[0] in {h[1] for h in left})
                found[d, j] = (len(mine), n, exact)
    return found


def parameterised(rng, words=40):
    """Prose with sentences, names, numbers and units."""
    out = []
    for k in range(words):
        x = rng.random()
        out.append(rng.choice(["Alice", "Bob", "Berlin"]) if x < 0.1 else f"{rng.randint(1, 60)}{rng.choice(['', ' km', ' %', '.5', 'kg'])}" if x < 0.2 else prose(rng, 1))
        if k % 9 == 8:
            out[-1] += "."
    return " ".join(out)


@pytest.mark.parametrize("block", [None, 99])
def test_leaks_equal_brute_force(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(decontaminate, "BLOCK", block)  # many passes
    rng = random.Random(21)
    items = [parameterised(rng, rng.choice([3, 6, 8, 12, 30, 60])) for _ in range(12)] + ["", None, "5 6 7 8 9 10 11 12 13", "Alice Bob Alice Bob Alice", parameterised(rng, 300)]
    items.append(items[4])
    swap = lambda t: t.replace("Alice", "Mia").replace("Berlin", "Rome").replace("1", "4")
    texts = []
    for k in range(40):
        item = rng.choice(items) or ""
        w = item.split()
        part = " ".join(w[rng.randint(0, len(w) // 2) :])
        part = rng.choice([lambda t: t, swap, lambda t: t.replace("Alice", "Tom", 1), str.upper, str.lower])(part)
        texts.append(f"{parameterised(rng, rng.randint(0, 40))} {part} {parameterised(rng, rng.randint(0, 20))}")
    texts += [None, "", "5 6 7 8 9 10 11 12 13 14", "x", parameterised(rng, 4_000) + " " + items[10] + " " + parameterised(rng, 4_000)]
    wide = clashing(docs_of(spark, texts))
    bench = clashing(spark.createDataFrame([*enumerate(items)], "item_id long, text string"))
    rows = decontaminate.leaks(wide, bench).collect()
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_matched, r.exact) for r in rows}
    want = brute_leaks(texts, items)
    assert len(rows) == len(got) and got == want and len(got) > 25 and {x[2] for x in got.values()} == {True, False}
    if not block:
        twice = decontaminate.leaks(wide.unionByName(wide), bench).collect()
        assert {(r.doc_id, r.item_id): (r.n_windows, r.n_matched, r.exact) for r in twice} == want and len(twice) == len(want)


def test_names_that_open_a_text_or_sentence_are_placeholders(spark):
    bench = spark.createDataFrame([(1, "Alice has 12 pens. Alice lends Bob 5 pens and then buys 3 more pens at the shop, how many pens does Alice have?")], "item_id long, text string")
    texts = ["Maria has 9 pens. Maria lends Tom 4 pens and then buys 2 more pens at the shop, how many pens does Maria have?"]
    assert [(r.item_id, r.n_matched > 0.6 * r.n_windows, r.exact) for r in decontaminate.leaks(docs_of(spark, texts), bench).collect()] == [(1, True, False)]


def test_leaks_with_null_and_repeated_keys(spark):
    item = "one river ran under seven bridges before it met the sea"
    docs = spark.createDataFrame([(None, item), (None, "other"), (3, "zz"), (3, item), (4, "zz")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (2, None), (5, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(None, None), (None, 5), (3, None), (3, 5)}
    assert sorted(map(str, (r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()))) == ["4", "None", "None"]
    assert decontaminate.leaks(docs.limit(0), bench.limit(0)).collect() == []



# 8 ------------------------------------------------------------------------------------------------------------------

PAGE = "page_id long, url string, html string"


def test_rules_hosts_and_paths(spark):
    cases = {
        "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"), "https://Example.NET/fr/x?q": ("example.net", "/fr/x", "net/", "block"), "http://b.example.com/de/#t": ("b.example.com", "/de/", "example.com/de/", "block"),
        "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"), "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "http://a.net": ("a.net", "", None, "allow"), "ftp://h/p://q": ("h", "/p://q", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "://net/": ("net", "/", "net/", "block"),
    }
    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(cases)], PAGE)
    wide = df.select("*", *(F.lit(7).alias(c) for c in ("host", "path", "rule", "trust", "n")))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(wide).collect()}
    assert got == dict(enumerate(cases.values()))
    assert url_filter.judged(spark.createDataFrame([], PAGE)).collect() == []


def test_link_propagation_equals_numpy(spark):
    link = lambda *to: "".join(f'<p><a class="x" href="https://{h}/p">t</a><a href="/in">i</a>' for h in to)
    pages = [("http://bad.net/x", link("other.info")), ("http://farm.info/", link("bad.net", "bad.net", "worse.net")), ("http://far.info/", link("farm.info")), ("http://good.org/fr/", link("friend.info", "farm.info")), ("http://friend.info/", link("friend.info")), ("http://ring1.info/", link("ring2.info", "bad.net")), ("http://ring2.info/", link("ring1.info", "friend.info")), ("http://worse.net/", None), ("http://alone.info/", ""), ("http://other.info/", link("other.info"))]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], PAGE)
    got = {r.host: r for r in url_filter.judged(df).collect()}
    hosts = sorted(got)
    n, at = len(hosts), {h: k for k, h in enumerate(hosts)}
    edge = np.zeros((n, n))
    for src, dst, k in [("bad.net", "other.info", 1), ("farm.info", "bad.net", 2), ("farm.info", "worse.net", 1), ("far.info", "farm.info", 1), ("good.org", "friend.info", 1), ("good.org", "farm.info", 1), ("ring1.info", "ring2.info", 1), ("ring1.info", "bad.net", 1), ("ring2.info", "ring1.info", 1), ("ring2.info", "friend.info", 1)]:
        edge[at[src], at[dst]] = k

    def walk(e, seeds):
        share = e / np.maximum(e.sum(axis=1, keepdims=True), 1)
        s = np.array([float(h in seeds) for h in hosts])
        s /= s.sum()
        lost = e.sum(axis=1) == 0
        x = s
        for _ in range(400):
            x = 0.15 * s + 0.85 * (x @ share + x[lost].sum() * s)
        return x * len(seeds)

    trust, distrust = walk(edge, {"good.org"}), walk(edge.T, {"bad.net", "worse.net"})
    for h in hosts:
        assert np.isclose(got[h].trust, trust[at[h]], atol=1e-5) and np.isclose(got[h].distrust, distrust[at[h]], atol=1e-5), h
    assert got["farm.info"].verdict == "block" and got["far.info"].verdict == "block" and got["friend.info"].verdict == "allow" and got["alone.info"].verdict == "allow"


# 4 ------------------------------------------------------------------------------------------------------------------


def mix_docs(spark):
    rng = random.Random(10)
    return spark.createDataFrame([(k, prose(rng, rng.randint(0, 80)) if k % 17 else None, rng.choice(["en", "de", None]), rng.choice(["big"] * 6 + ["small"]), 0) for k in range(400)], DOC)


def test_mixing_meets_its_targets(spark, monkeypatch):
    docs = mix_docs(spark)
    targets = {"source": {"big": 0.5, "small": 0.5}}
    rows = mixing.calibrated(clashing(docs), targets=targets, share=0.3).collect()
    assert len(rows) == 400
    total, have = sum(r._tokens for r in rows), collections.Counter()
    for r in rows:
        assert r._tokens == len(token_counts.tokenizer(None, "byte_bpe_50k.json").encode(r.text or "").ids)
        assert (r._topic is None) == (not WORD.findall(r.text or ""))
        have[r.source] += r._tokens * r._weight
    assert abs(have["small"] / sum(have.values()) - 0.5) < 1e-6
    told = {(r.margin, r.value): r for r in mixing.marginals(docs, targets=targets, share=0.3).collect()}
    assert abs(told["source", "small"].raked - 0.5) < 1e-6 and abs(told["source", "small"].target - 0.5) < 1e-9
    assert abs(sum(r.expected for k, r in told.items() if k[0] == "topic") - 1) < 1e-9
    assert abs(sum(r._tokens * r._probability for r in rows) - 0.3 * total) < 1e-3 * total
    assert all(0 < r._probability <= 1 for r in rows)
    monkeypatch.setattr(mixing, "CELLS", 0)  # the same on Spark alone
    slow = {r.doc_id: r for r in mixing.calibrated(docs, targets=targets, share=0.3).collect()}
    assert max(abs(slow[r.doc_id]._probability - r._probability) for r in rows if r._tokens) < 1e-3
    assert mixing.calibrated(empty(spark)).collect() == []


def test_raking_equals_plain_fitting():
    """Iterative proportional fitting on a dense array of three axes."""
    rng = np.random.default_rng(5)
    cube = rng.integers(1, 1000, (4, 3, 5)).astype(float)
    goals = [x / x.sum() for x in (rng.random(4), rng.random(3), rng.random(5))]
    w = cube.copy()
    for _ in range(500):
        for axis, goal in enumerate(goals):
            other = tuple(a for a in range(3) if a != axis)
            w *= (goal / (w.sum(axis=other) / w.sum())).reshape([-1 if a == axis else 1 for a in range(3)])
    got = mixing.rake(cube.ravel(), [x.ravel() for x in np.indices(cube.shape)], goals) * cube.ravel()
    assert np.allclose(got / got.sum(), w.ravel() / w.sum(), atol=1e-8)


def test_topics_are_found(spark):
    rng = random.Random(15)
    styles = [["ba", "do", "ke"], ["xum", "vrel", "tosk"], ["eau", "ille", "oux"]]
    docs = docs_of(spark, [prose(rng, 60, styles[k % 3]) for k in range(90)] + [None, " "])
    topics = mixing.learned_topics(docs, "doc_id", "text")
    again = mixing.learned_topics(docs.repartition(5), "doc_id", "text")
    assert np.allclose(topics.centres, again.centres)
    rows = {r.doc_id: r._topic for r in mixing.calibrated(docs).collect()}
    assert rows[90] is None and rows[91] is None
    for k in range(3):
        assert not {rows[d] for d in range(90) if d % 3 == k} & {rows[d] for d in range(90) if d % 3 != k}


def test_topics_are_learned_from_all_documents(spark):
    """The weights of words count every document, and counts over a byte keep their value and order."""
    counts = np.zeros((4, mixing.BUCKETS), dtype=np.int64)
    counts[:, -1], counts[:, 0] = [254, 255, 70_000, 3], [1, 300, 2, 9]
    v = mixing.packed(counts)
    assert (mixing.unpacked(pa.array(v, pa.binary())) == counts).all() and sorted(v) == [v[k] for k in (3, 0, 1, 2)]
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha"), F.when(F.col("id") % 3 == 0, " beta").otherwise(" gamma delta")).alias("text"))
    hashed = mixing.word_vectors(np.frombuffer(b"beta", np.uint8), np.array([0, 4]))[0].argmax()
    topics = mixing.learned_topics(docs, "doc_id", "text")
    assert np.isclose(topics.weight[hashed], np.log(9_001 / 3_001) + 0.1) and len(topics.centres) == 2


def test_logs_are_computed_for_wide_rows_alone(monkeypatch):
    """A row with counts over a byte does not make its whole block dear; one beyond it is whole, bytes of 255 in wide counts included."""
    counts = np.random.default_rng(9).integers(0, 255, (50, mixing.BUCKETS))
    counts[7, [0, 3, 4, 200, -1]] = [255, 65_535, 1 << 24, 256, 0xFFFFFFFF]
    counts[49, 5], counts[20] = 70_000, 255
    batch, log1p, cells = pa.RecordBatch.from_arrays([pa.array(mixing.packed(counts), pa.binary())], ["v"]).slice(2), np.log1p, []
    monkeypatch.setattr(np, "log1p", lambda x: cells.append(np.size(x)) or log1p(x))
    topics = mixing.Topics(np.ones(mixing.BUCKETS), np.eye(2, mixing.BUCKETS))
    got = [x for k in range(0, batch.num_rows, 20) for x in topics.of(batch.column(0).slice(k, 20))]
    assert got == [f"topic{int(a < b)}" for a, b in counts[2:, :2]] and sum(cells) == 3 * mixing.BUCKETS
    assert (mixing.unpacked(batch.column(0)) == counts[2:]).all() and np.array_equal(mixing.logs(batch.column(0)), log1p(counts[2:]))


def test_the_mixing_stage_learns_topics_from_every_document(spark, monkeypatch):
    """More documents than the former sample had: the counts of all of them reach the fit."""
    seen, fitted = [], mixing.topics_of
    monkeypatch.setattr(mixing, "topics_of", lambda words: seen.append(words.count()) or fitted(words, 1))
    monkeypatch.setattr(mixing, "TOPIC_ROUNDS", 1)
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(10).alias("n_chars"))
    assert 4_000 < corpus_pipeline.mixed(spark, docs, "").count() < 5_000 and seen == [9_000]


def test_many_cells_are_raked_as_few_are(spark, monkeypatch):
    """Sparse cells, which converge slowly: both paths do the same rounds."""
    rng = random.Random(11)
    rows = [(k, f"s{k // 2}", rng.choice(["en", "de", "fr"]), rng.choice("abcd"), rng.randint(1, 1000)) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n long").withColumn("text", F.lit("x"))
    monkeypatch.setattr(mixing, "ROUNDS", 16)
    options = {"topic": "topic", "tokens": "n", "share": 0.3, "targets": {"source": {f"s{k}": float(1 + k % 7) for k in range(40)}}}
    few = {r.doc_id: r for r in mixing.calibrated(docs, **options).collect()}
    monkeypatch.setattr(mixing, "CELLS", 0)
    many = {r.doc_id: r for r in mixing.calibrated(docs, **options).collect()}
    assert all(np.isclose(many[k]._weight, r._weight, rtol=1e-9) and np.isclose(many[k]._probability, r._probability, rtol=1e-9) for k, r in few.items())


def test_sampling_repeats_and_columns_stay(spark):
    docs = clashing(mix_docs(spark))
    once, again = mixing.mixed(docs), mixing.mixed(docs.repartition(7))
    assert {r.doc_id for r in once.collect()} == {r.doc_id for r in again.collect()}
    assert once.columns[: len(docs.columns)] == docs.columns


# The pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_on_the_smallest_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "decontaminate", "mixing"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = now.count()
        now = corpus_pipeline.stored(stage(spark, now, d))
        assert 0 < now.count() <= before, name
        if name != "mixing":
            assert now.columns == docs.columns
        ids = [r.doc_id for r in now.collect()]
        if name == "near_dedup":
            want = brute_near([texts[k] for k in sorted(texts)], 5, 80)
            assert sorted(ids) == [k for k, (_, root) in zip(sorted(texts), want, strict=True) if sorted(texts)[root] == k]
            kept = {r.doc_id: r.text for r in now.collect()}
        if name == "suffix_dedup":
            raw, gone = brute_cut([kept[k] for k in sorted(kept)], 200)
            for r in now.collect():
                k = sorted(kept).index(r.doc_id)
                assert r.text == bytes(np.frombuffer(raw[k], np.uint8)[~gone[k]]).decode("utf-8", "ignore") and r.n_chars == len(r.text)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, name):
    """Nulls in any column, empty and very long texts, repeats and clashing names; then no rows at all."""
    d, stage = "/root/testdata/sf0.001", dict(corpus_pipeline.STAGES)[name]
    rng = random.Random(19)
    odd = [(k, t, rng.choice(["en", "de", None]), rng.choice(["s", None]), None if t is None else len(t)) for k, t in enumerate(odd_texts(rng) + [prose(rng, 60) for _ in range(20)])]
    odd += [odd[-1], (None, odd[-1][1], "en", "s", 1), (None, None, None, None, None)]
    docs = clashing(spark.createDataFrame(odd, DOC))
    got = stage(spark, docs, d)
    rows = got.collect()
    assert got.columns[: len(docs.columns)] == docs.columns and len(rows) <= len(odd)
    assert name == "mixing" or len(rows) > 15
    assert stage(spark, docs.limit(0), d).collect() == []


def test_word_hashes_depend_on_the_word_only():
    data = np.frombuffer(b"one two one  two\none", np.uint8)
    s, e, doc = _text.word_spans(data, np.array([0, 7, 20]))
    h = _text.span_hashes(data, s, e)
    assert [bytes(data[a:b]) for a, b in zip(s, e, strict=True)] == [b"one", b"two", b"one", b"two", b"one"]
    assert h[0] == h[2] == h[4] and h[1] == h[3] != h[0] and doc.tolist() == [0, 0, 1, 1, 1]
