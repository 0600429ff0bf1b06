"""Token counts by a map-side two-tier lookup of pre-token lengths.

Tier 1 is a broadcast table from frequent pre-tokens to the number of tokens each encodes to.
Tier 2 is a cache in each Python worker: a pre-token that tier 1 lacks is encoded once by the
library and remembered. Nothing is shuffled: a document is counted where it is read, and the frequent pre-tokens
come from lists that the tasks over a bounded sample send to the driver.

Defined results: a null text counts as empty (0 bytes, 0 tokens); every text is read whole;
repeated rows are counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections import Counter as Bag
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._spark import bounded, table

#: Letters, numbers and white space among the code points up to U+024F.
L, N, S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
#: Fixed value: the published split pattern of byte-level BPE, written out for those code points.
SPLIT = re.compile(f" ?[{L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+").findall
#: Texts of these code points alone are split by the pattern above (tests compare all of them with the library).
PLAIN = re.compile(r"[\x00-ɏ]*").fullmatch
#: Fixed value: the same pattern for all of Unicode, with the white space of the library.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE = regex.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+").findall

#: Entries of tier 1: its size is bounded by this, whatever the corpus.
FREQUENT = 65_536
#: Documents that are read to choose them, and pre-tokens that each of them names at most: so the lists are bounded, too. The
#: choice moves time only, never a count.
SAMPLE_DOCS, NAMED = 2_000, 512
#: Entries of a worker's cache; a full one is emptied.
CACHE = 400_000


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _unsettled():
    """Finds characters that libraries of other Unicode versions may class otherwise: letters and numbers younger than
    Unicode 3.2, and those that aren't assigned yet. Only a text with one of them is encoded whole by the library."""
    now, old = unicodedata.category, unicodedata.ucd_3_2_0.category
    odd = [c for c in range(0x250, 0x110000) if now(chr(c)) == "Cn" or now(chr(c))[0] in "LN" and old(chr(c))[0] != now(chr(c))[0] or now(chr(c))[0] not in "LN" and old(chr(c))[0] in "LN"]
    starts = [c for c, before in zip(odd, [-1, *odd], strict=False) if c != before + 1]
    ends = [c for c, after in zip(odd, [*odd[1:], -1], strict=True) if c != after - 1]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]").search


@functools.cache
def tokenizer(path: str | None, name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or vocabulary_file(name))


def _byte_of() -> dict[str, int]:
    """Which byte each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*shown}))}


@functools.cache
def _plan(path: str | None, name: str):
    """(pattern of the added tokens or None, function that counts the tokens of one pre-token), None if the file isn't plain byte-level BPE.

    Where ids rise in the order of the merges, the merge of the lowest id is the merge of the lowest
    rank, and the faster library for ranks gives the same tokens of a pre-token; else it isn't used.
    """
    t = tokenizer(path, name)
    config = json.loads(t.to_str())
    pre, model = config["pre_tokenizer"] or {}, config["model"]
    if config["normalizer"] or config["post_processor"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE":
        return None
    added = [x["content"] for x in config["added_tokens"]]
    ids = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    count = lambda p: len(t.encode(p, add_special_tokens=False).ids)
    if not model["dropout"] and not model["ignore_merges"] and ids == [*range(256, 256 + len(ids))]:
        import tiktoken

        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): n for token, n in model["vocab"].items() if token not in added}
        encode = tiktoken.Encoding(name, pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        count = lambda p: len(encode(p))
    return (re.compile("|".join(map(re.escape, added))) if added else None), count


class Counter:
    """Counts the tokens of texts, with the two tiers."""

    def __init__(self, frequent: dict[str, int], path: str | None = None, name: str = "byte_bpe_50k.json"):
        self.tier1, self.tier2, self.path, self.name = frequent, {}, path, name

    def _encode(self, text: str) -> int:
        return len(tokenizer(self.path, self.name).encode(text, add_special_tokens=False).ids)

    def pre_tokens(self, text: str) -> list[str] | None:
        """None where only the library's own reading is known to be right."""
        plan = _plan(self.path, self.name)
        if plan is None or (plan[0] and plan[0].search(text)):
            return None
        if PLAIN(text):
            return SPLIT(text)
        return None if _unsettled()(text) else WIDE(text)

    def count(self, text: str) -> int:
        parts = self.pre_tokens(text)
        if parts is None:
            return self._encode(text)
        tier1, tier2 = self.tier1, self.tier2
        try:
            return sum([tier1[p] for p in parts])
        except KeyError:
            pass
        total, encode = 0, _plan(self.path, self.name)[1]
        for p in parts:
            n = tier1.get(p)
            if n is None:
                n = tier2.get(p)
                if n is None:
                    n = encode(p)
                    if len(tier2) >= CACHE:
                        tier2.clear()
                    if len(p) <= 256:
                        tier2[p] = n
            total += n
        return total


def frequent_lengths(docs: DataFrame, text: str, key: str, path: str | None, name: str, size: int = FREQUENT) -> dict[str, int]:
    """Tier 1: the most frequent pre-tokens of a bounded sample, then single tokens of the vocabulary."""
    counter = Counter({}, path, name)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag: Bag = Bag()
        for b in batches:
            for x in b.column(0):
                bag.update(dict(Bag(counter.pre_tokens(x.as_py() or "") or ()).most_common(NAMED)))
        yield pa.RecordBatch.from_pydict({"p": pa.array([*bag], pa.string()), "n": pa.array([*bag.values()], pa.int64())})

    some = bounded(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "k", SAMPLE_DOCS).select("t")
    bag: Bag = Bag()
    for r in some.mapInArrow(count, "p string, n long").collect():
        bag[r.p] += r.n
    found = {p: counter._encode(p) for p, _ in sorted(bag.items(), key=lambda x: (-x[1], x[0]))[:size]}
    if _plan(path, name):
        for token in sorted(tokenizer(path, name).get_vocab(), key=tokenizer(path, name).get_vocab().get) if len(found) < size else ():
            word = token.replace("Ġ", " ")
            if len(found) < size and word not in found and word.isascii() and counter.pre_tokens(word) == [word]:
                found[word] = counter._encode(word)
    return found


def fitted_counter(docs: DataFrame, key: str, text: str, path: str | None = None, name: str = "byte_bpe_50k.json") -> Counter:
    return Counter(frequent_lengths(docs, text, key, path, name), path, name)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", *, limit: int = 1024, path: str | None = None, name: str = "byte_bpe_50k.json") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs."""
    kind = docs.schema[key].dataType.simpleString()
    counter = docs.sparkSession.sparkContext.broadcast(fitted_counter(docs, key, text, path, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter.value
        for b in batches:
            n_bytes, n_tokens = [], []
            for x in b.column(1):
                x = x.as_py() or ""
                n_bytes.append(len(x.encode()))
                n_tokens.append(c.count(x))
            n = np.array(n_tokens, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
