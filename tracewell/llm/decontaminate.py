"""Benchmark decontamination by template canonicalisation.

Numbers, names and units in a text become typed placeholders, the rest lower-case words: so a question with other
numbers or names has the same template. A name is a capitalised word, wherever it stands: at the head of a sentence
nothing in the text tells a name from another word, so both are placeholders there, on both sides alike.

One pass over the documents hashes the template of each window of WINDOW words (or of an item's own length, if that is
shorter) and keeps the windows whose hash the benchmark has; only these carry their words on. A window with
fewer than WORDS words that aren't placeholders says too little as a template, so it matches by its values. The benchmark's
hashes are broadcast, BLOCK at a time, with a pass over the documents for each block.

Slots: a name or unit of the benchmark that stands, in one alignment, for two values of the document is inconsistent, and the
windows that hold it don't count. Equal numbers stand for different ones freely, as small numbers coincide often.

A document leaks an item if it has at least SHARE of the item's windows, or of those that match by their template, or
ENOUGH of them. SQL functions only.

Defined results: null and empty texts, on either side, match nothing; texts are read whole; items with
equal text are each reported; an item that repeats a key is judged with the other's windows, as one item; repeated rows of a
document are judged together, equal or not; rows with a null key are judged but can't be told apart; an empty
table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._spark import stored, table

WINDOW, WORDS = 8, 4
SHARE = 0.1
#: Matched windows that suffice however long the item is: a passage of 30 words.
ENOUGH = 23
#: Hashes of the benchmark that are broadcast at once, 16 MB or so.
BLOCK = 200_000

#: Words, numbers, and single signs for units.
TOKEN = r"[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*|[%\p{N}&&[^0-9]]+"
#: Units that are recognised after a number.
UNITS = "kilometers kilometres centimeters centimetres millimeters meters metres miles inches feet yards kilograms grams pounds ounces liters litres gallons percent dollars euros cents hours minutes seconds days weeks months years km cm mm kg mg lb oz ml mph kmh % m g l h s".split()
#: Marks before the raw value of a placeholder; every other word of a template is greater than PLAIN.
NUMBER, UNIT, NAME, PLAIN = "\x01", "\x02", "\x03", "\x04"


def _numeric(word: Column) -> Column:
    return (word >= "0") & (word < ":")


def templates(rows: DataFrame, text: str) -> DataFrame:
    """rows with ws in place of text: the words of its template, a placeholder being its mark and raw value."""
    rest = [c for c in rows.columns if c != text]

    def word(x: Column, i: Column) -> Column:
        low = F.lower(x)
        plain = F.when((i > 0) & _numeric(F.get("parts", i - 1)) & low.isin(UNITS), F.concat(F.lit(UNIT), low)).otherwise(low)
        return F.when(_numeric(x), F.concat(F.lit(NUMBER), x)).when(x == low, plain).when(x.rlike(r"^\p{Lu}\p{Ll}"), F.concat(F.lit(NAME), low)).otherwise(plain)

    parts = rows.select(*rest, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), 0).alias("parts"))
    return parts.select(*rest, F.transform("parts", word).alias("ws"))


def _windows(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """rows (k, ws) with h, pos and words for each window of each size; h is the hash of the window's template."""
    hashed = rows.select("k", "ws", F.transform("ws", lambda x: F.xxhash64(F.when(x < PLAIN, F.substring(x, 1, 1)).otherwise(x))).alias("hs"))

    def of(size: int) -> Column:
        return F.transform("hs", lambda x, i: F.when(i <= F.size("hs") - size, F.xxhash64(F.lit(size), x, *(F.get("hs", i + k) for k in range(1, size)))))

    every = hashed.select("k", "ws", F.concat(*map(of, sizes)).alias("all"))
    # The outer form, lest the optimizer filter by the size of an array that it then computes twice.
    return every.select("k", "ws", F.posexplode_outer("all").alias("at", "h")).where(F.col("h").isNotNull())


def _seen(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """k, h, pos, words, rich and key (by which a window matches) of the windows that _windows gives."""
    n = F.size("ws")
    size = F.element_at(F.array(*map(F.lit, sizes)), F.floor(F.col("at") / n).cast("int") + 1)
    # Written here, lest a filter on what follows be evaluated for every window of every document, each with all words.
    cut = stored(windows.select("k", "h", (F.col("at") % n).alias("pos"), F.slice("ws", F.col("at") % n + 1, size).alias("words")))
    told = cut.select("*", (F.size(F.filter("words", lambda x: x >= PLAIN)) >= WORDS).alias("rich"))
    return told.select("*", F.when(F.col("rich"), F.col("h")).otherwise(F.xxhash64(F.lit("values"), "words")).alias("key"))


def _values(words: str) -> Column:
    return F.filter(words, lambda x: x < PLAIN)


def _benchmark(items: DataFrame, key: str, text: str) -> tuple[DataFrame, list[int]]:
    """item, h, key, ipos, ivalues, rich, all and all_rich (numbers of the item's windows) of the benchmark, and the sizes used."""
    rows = stored(templates(items.select(F.col(key).alias("k"), F.col(text).alias("t")), "t").where(F.size("ws") > 0))
    sizes = sorted(r[0] for r in rows.select(F.least(F.size("ws"), F.lit(WINDOW))).distinct().collect())  # at most WINDOW values
    out = None
    for size in sizes or [WINDOW]:
        some = rows.where(F.least(F.size("ws"), F.lit(WINDOW)) == size)
        found = _seen(_windows(some, [size]), [size])
        out = found if out is None else out.unionByName(found)
    whole = out.groupBy("k").agg(F.count("*").alias("all"), F.count_if("rich").alias("all_rich")).withColumnRenamed("k", "_k")
    both = out.join(whole, F.col("k").eqNullSafe(F.col("_k")))
    return stored(both.select(F.col("k").alias("item"), "h", "key", F.col("pos").alias("ipos"), _values("words").alias("ivalues"), "rich", "all", "all_rich")), sizes or [WINDOW]


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """key, item, n_windows (of the item), n_matched and exact, for each document and item it leaks.

    exact: every placeholder has the item's own value; else the item was re-parameterised.
    """
    bench, sizes = _benchmark(items, item, item_text)
    hashes = bench.select("h").distinct()
    blocks = -(-hashes.count() // BLOCK) or 1
    windows = _windows(templates(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "t"), sizes)
    found = None
    for b in range(blocks):
        hit = windows.join(F.broadcast(hashes.where(F.pmod("h", F.lit(blocks)) == b)), "h", "left_semi")
        found = hit if found is None else found.unionByName(hit)
    hits = stored(_seen(found, sizes).drop("h", "rich").join(bench.drop("h"), "key").select("k", "item", "all", "all_rich", "rich", "ipos", (F.col("pos") - F.col("ipos")).alias("shift"), _values("words").alias("values"), "ivalues"))
    slots = hits.where("rich and size(ivalues) > 0").select("k", "item", "shift", F.explode(F.arrays_zip(F.col("ivalues").alias("i"), F.col("values").alias("d"))).alias("s")).select("k", "item", "shift", "s.i", "s.d")
    slots = slots.groupBy("k", "item", "shift", "i").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    torn = (F.substring("i", 1, 1) != NUMBER) & (F.col("lo") != F.col("hi"))
    slots = slots.groupBy("k", "item", "shift").agg(F.collect_set(F.when(torn, F.col("i"))).alias("torn"), F.min((F.col("lo") == F.col("i")) & (F.col("hi") == F.col("i"))).alias("same"))
    slots = slots.withColumnsRenamed({"k": "_k", "item": "_item", "shift": "_shift"})
    on = hits["k"].eqNullSafe(slots["_k"]) & hits["item"].eqNullSafe(slots["_item"]) & (hits["shift"] == slots["_shift"])
    kept = hits.join(slots, on, "left").where(~F.col("rich") | ~F.coalesce(F.arrays_overlap("ivalues", "torn"), F.lit(False)))
    told = kept.groupBy("k", "item").agg(F.max("all").alias("n_windows"), F.max("all_rich").alias("all_rich"), F.size(F.collect_set("ipos")).alias("n_matched"), F.size(F.collect_set(F.when(F.col("rich"), F.col("ipos")))).alias("n_rich"), F.min(F.coalesce("same", F.lit(True))).alias("exact"))
    return told.where((F.col("n_matched") >= F.least(F.col("n_windows") * share, F.lit(ENOUGH))) | (F.col("n_rich") > 0) & (F.col("n_rich") >= F.col("all_rich") * share)).select(F.col("k").alias(key), F.col("item").alias(item), F.col("n_windows").cast("long").alias("n_windows"), F.col("n_matched").cast("long").alias("n_matched"), "exact")


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without those that leak an item; rows with a null key stay."""
    gone = leaks(docs, items, key, text, **options).where(F.col(key).isNotNull()).select(key).distinct()
    return docs.join(gone, key, "left_anti").select(docs.columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
