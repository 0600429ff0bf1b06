"""Quality rules: counted statistics, and robust multivariate outliers by minimum covariance determinant.

The statistics of a text are counted with SQL functions in one pass. Documents that fail the base rules are
out. For the others a vector of transformed statistics is compared with its group, (language, source): the
location and scatter of the group are minimum-covariance-determinant estimates, found by concentration
steps from three starts: take the HALF of the group's documents that are nearest in Mahalanobis distance, re-estimate
from them, again; after two steps the start with the smallest determinant goes on until the determinant gets no smaller.
A document is rejected if its squared distance is over CUT.

Every step is an aggregation with few rows a group: quantiles are read from histograms of fixed bins, so no group
is ever gathered or sorted. The scatter's diagonal is at a floor at least, since statistics such as the number of symbols are constant
in clean text. Cholesky factors are column expressions. Groups of fewer than GROUP documents take their
language's estimates, and languages of fewer than that those of all documents.

Defined results: a null text has no words and fails the base rules, as does an empty one; texts are read whole;
null languages and sources are values of their own; ties fall on the same side; repeated rows count each
and get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm._spark import dropped, stored, table

#: The share of a group that the estimates rest on, and the fall of half the determinant's logarithm that is worth a step.
HALF, CLOSE = 0.75, 1e-3
GROUP = 100
#: Squared distances over this are outliers: the 1 - 1e-7 quantile of the chi-squared distribution with 5 degrees of freedom.
CUT = 40.86
#: Transformed statistics and the smallest standard deviation that is believed of each.
VECTOR = {"v_words": 0.5, "v_length": 0.05, "v_symbols": 0.35, "v_lines": 0.6, "v_repeats": 0.6}
#: Median of the chi-squared distribution with 5 degrees of freedom, to make the scatter consistent.
MEDIAN_5 = 4.351
#: Groups up to this number are broadcast.
FEW = 20_000
NAMES = [*VECTOR]
D = len(NAMES)
BLANK = " \t\n\x0b\f\r"


def counts(text: Column) -> dict[str, Column]:
    """The base statistics but for repeated words."""
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    bare = F.translate(text, BLANK, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANK, "") != "")
    return {
        "word_chars": none(F.length(bare)),
        "n_symbols": none(F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))),
        "n_dup_lines": none(F.size(lines) - F.size(F.array_distinct(lines))),
    }


def measured(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """key, more, n_words and the base statistics of every row."""
    # Windows of three words are sorted by hash; those next to an equal one are repeated, and their places count
    # min(3, distance to the next such place) words each.
    base = docs.select(F.col(key), *map(F.col, more), F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_words"), *(c.alias(n) for n, c in counts(F.col(text)).items()))
    w = F.col("_words")
    places = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    base = base.select("*", F.size(w).cast("long").alias("n_words"), F.sort_array(places).alias("_s")).drop("_words")
    s = F.col("_s")
    beside = F.arrays_zip(s.alias("x"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).alias("p"), F.slice(s, 2, F.greatest(F.size(s), F.lit(1))).alias("n"))
    again = F.filter(beside, lambda z: z["x"].isNotNull() & (z["x"]["h"].eqNullSafe(z["p"]["h"]) | z["x"]["h"].eqNullSafe(z["n"]["h"])))
    base = base.select("*", F.sort_array(F.transform(again, lambda z: z["x"]["i"])).alias("_at")).drop("_s")
    covered = F.aggregate("_at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n"), i.alias("last")), lambda a: a["n"])
    return base.select(key, *more, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    share = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return [
        F.log1p("n_words").alias("v_words"),
        F.log(F.greatest(share("word_chars", "n_words"), F.lit(0.1))).alias("v_length"),
        F.log1p(100 * share("n_symbols", "word_chars")).alias("v_symbols"),
        F.log1p(F.col("n_dup_lines")).alias("v_lines"),
        F.log1p(100 * share("n_repeat_words", "n_words")).alias("v_repeats"),
    ]


def _ranked(bins: DataFrame, by: list[str], share: float, at: str) -> DataFrame:
    """For each by: the lowest bin up to which share of the rows lie; bins is (*by, bin, n)."""
    up = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by)
    return bins.select(*by, "bin", F.sum("n").over(up).alias("c"), F.sum("n").over(all_).alias("all")).where(F.col("c") >= F.ceil(F.col("all") * share)).groupBy(*by).agg(F.min("bin").alias(at))


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, the mean and the lower triangle of the covariance, its diagonal at the floor at least, as m_i and c_i_j."""
    sums = [F.count("*").alias("n"), *(F.sum(v).alias(f"s_{v}") for v in NAMES), *(F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q_{i}_{j}") for i in range(D) for j in range(i + 1))]
    means = rows.groupBy(*by).agg(*sums).select("*", *((F.col(f"s_{v}") / F.col("n")).alias(f"m_{i}") for i, v in enumerate(NAMES)))
    cov = lambda i, j: F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")
    return means.select(*by, *(f"m_{i}" for i in range(D)), *((F.greatest(cov(i, i), F.lit(VECTOR[NAMES[i]] ** 2)) if i == j else cov(i, j)).alias(f"c_{i}_{j}") for i in range(D) for j in range(i + 1)))


def _factored(moments: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_i_j of the scatter, a column at a time."""
    for j in range(D):
        moments = moments.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(F.col(f"c_{j}_{j}") - sum((F.col(f"l_{j}_{k}") ** 2 for k in range(j)), F.lit(0.0)), F.lit(1e-9))))
        if j + 1 < D:
            moments = moments.withColumns({f"l_{i}_{j}": (F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l_{j}_{j}") for i in range(j + 1, D)})
    return moments.drop(*(f"c_{i}_{j}" for i in range(D) for j in range(i + 1)))


def _distances(rows: DataFrame, model: DataFrame, few: bool) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance from its group's estimates."""
    joined = rows.join(F.broadcast(model) if few else model, "g")
    for i, v in enumerate(NAMES):
        z = (F.col(v) - F.col(f"m_{i}") - sum((F.col(f"l_{i}_{k}") * F.col(f"z_{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l_{i}_{i}")
        joined = joined.withColumn(f"z_{i}", z)
    return joined.select(*rows.columns, *(c for c in model.columns if c == "start"), sum((F.col(f"z_{i}") ** 2 for i in range(1, D)), F.col("z_0") ** 2).alias("d2"))


def _bin_of(d2: str) -> Column:
    return F.floor(F.log(F.greatest(F.col(d2), F.lit(1e-9))) * 64)


MODEL = [*(f"m_{i}" for i in range(D)), *(f"l_{i}_{j}" for i in range(D) for j in range(i + 1))]


def _size() -> Column:
    """The logarithm of the determinant of a factored scatter, halved."""
    return sum((F.log(f"l_{i}_{i}") for i in range(1, D)), F.log("l_0_0"))


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """g, start and a model for each of three starts: medians and quartiles of each statistic on its own; the moments of all
    rows; those of the rows within the fences, 1.5 times the quartiles' distance beyond them, of every statistic."""
    bins = rows.select("g", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(v) * 64).alias("bin")) for i, v in enumerate(NAMES)))).alias("e")).groupBy("g", "e.i", "e.bin").agg(F.count("*").alias("n"))
    bins = stored(bins)
    spread = _ranked(bins, ["g", "i"], 0.25, "q1").join(_ranked(bins, ["g", "i"], 0.5, "q2"), ["g", "i"]).join(_ranked(bins, ["g", "i"], 0.75, "q3"), ["g", "i"])
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    own = spread.groupBy("g").agg(*(((pick("q2", i) + 0.5) / 64).alias(f"m_{i}") for i in range(D)), *((pick("q1", i) / 64).alias(f"q1_{i}") for i in range(D)), *(((pick("q3", i) + 1) / 64).alias(f"q3_{i}") for i in range(D)))
    own = stored(own)
    width = lambda i: F.col(f"q3_{i}") - F.col(f"q1_{i}")
    first = own.select("g", F.lit(0).alias("start"), *(f"m_{i}" for i in range(D)), *((F.greatest((width(i) - 1 / 64) / 1.349, F.lit(VECTOR[NAMES[i]])) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i in range(D) for j in range(i + 1)))
    fences = own.select("g", *((F.col(f"q1_{i}") - 1.5 * width(i)).alias(f"lo_{i}") for i in range(D)), *((F.col(f"q3_{i}") + 1.5 * width(i)).alias(f"hi_{i}") for i in range(D)))
    inside = rows.join(F.broadcast(fences) if few else fences, "g")
    for i, v in enumerate(NAMES):
        inside = inside.where(F.col(v).between(F.col(f"lo_{i}"), F.col(f"hi_{i}")))
    made = lambda x, k: _factored(_moments(x, ["g"])).withColumn("start", F.lit(k)).select("g", "start", *MODEL)
    return stored(first.select("g", "start", *MODEL).unionByName(made(rows, 1)).unionByName(made(inside.select("g", *NAMES), 2)))


def _step(rows: DataFrame, model: DataFrame, few: bool) -> DataFrame:
    """A concentration step: the model (g, start, ...) of the HALF of each group's rows that are nearest to its model."""
    far = _distances(rows, model, few).withColumn("bin", _bin_of("d2"))
    top = _ranked(far.groupBy("g", "start", "bin").agg(F.count("*").alias("n")), ["g", "start"], HALF, "top")
    near = far.join(F.broadcast(top) if few else top, ["g", "start"]).where("bin <= top")
    return stored(_factored(_moments(near, ["g", "start"])).select("g", "start", *MODEL))


def estimates(rows: DataFrame, few: bool) -> DataFrame:
    """g with m_i and l_i_j: the robust location and factored scatter of rows (g, *VECTOR).

    Two steps from each start; then the start of the smallest determinant goes on until no determinant gets smaller.
    """
    model = _starts(rows, few)
    for _ in range(2):
        model = _step(rows, model, few)
    best = model.groupBy("g").agg(F.min_by(F.struct("start", *MODEL), F.struct(_size(), "start")).alias("b")).select("g", "b.*")
    model = stored(best)
    while True:
        after = _step(rows, model, few)
        was = model.select("g", _size().alias("was"), F.struct("start", *MODEL).alias("old"))
        both = after.select("g", _size().alias("is"), F.struct("start", *MODEL).alias("new")).join(was, "g")
        smaller = F.col("is") < F.col("was") - CLOSE  # so each determinant falls by a factor in each round but the last
        chosen = stored(both.select("g", smaller.alias("smaller"), F.when(F.col("is") < F.col("was"), F.col("new")).otherwise(F.col("old")).alias("b")))
        dropped(model, after)
        model = chosen.select("g", "b.*")
        if chosen.where("smaller").isEmpty():
            break
        model = stored(model)
        dropped(chosen)
    # Consistency: half of the distances should be under the chi-squared median; the scatter only grows by this.
    far = _distances(rows, model, few).withColumn("bin", _bin_of("d2"))
    mid = _ranked(far.groupBy("g", "bin").agg(F.count("*").alias("n")), ["g"], 0.5, "mid")
    grow = F.sqrt(F.greatest(F.exp((F.col("mid") + 0.5) / 64) / MEDIAN_5, F.lit(1.0)))
    return stored(model.join(mid, "g").select("g", *(f"m_{i}" for i in range(D)), *((F.col(f"l_{i}_{j}") * grow).alias(f"l_{i}_{j}") for i in range(D) for j in range(i + 1))))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """key, the statistics, base_failed, kept and d2 (null where base_failed) of every row."""
    named = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.to_json(F.struct(F.col(lang).alias("l"))).alias("gl"), F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s"))).alias("gs"))
    all_ = stored(measured(named, "k", "t", "gl", "gs").withColumn("base_failed", failed()))
    fine = all_.where("not base_failed").select("gl", "gs", *vector())
    sizes = stored(fine.groupBy("gl", "gs").count())
    large = lambda g: sizes.groupBy(g).agg(F.sum("count").alias("n")).where(F.col("n") >= GROUP).select(g, F.lit(True).alias(f"has_{g}"))
    groups = stored(sizes.join(large("gs"), "gs", "left").join(large("gl"), "gl", "left").select("gs", F.when(F.col("has_gs"), F.concat(F.lit("s"), "gs")).when(F.col("has_gl"), F.concat(F.lit("l"), "gl")).otherwise("all").alias("g")))
    few = groups.count() <= FEW
    levels = fine.select(F.explode(F.array(F.concat(F.lit("s"), "gs"), F.concat(F.lit("l"), "gl"), F.lit("all"))).alias("g"), *NAMES)
    wanted = groups.select("g").distinct()
    model = estimates(stored(levels.join(F.broadcast(wanted) if few else wanted, "g")), few)
    rows = all_.where("not base_failed").join(F.broadcast(groups) if few else groups, "gs").select("k", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "g", *vector())
    kept = _distances(rows, model, few).withColumn("kept", F.col("d2") <= CUT)
    columns = ["k", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2"]
    out = all_.where("base_failed").withColumns({"kept": F.lit(False), "d2": F.lit(None).cast("double")})
    return kept.select(columns).unionByName(out.select(columns)).withColumnRenamed("k", key)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
