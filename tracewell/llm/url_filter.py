"""URL filter: rules first, then trust and distrust propagated over host links.

A page that a rule fits gets that rule's verdict. The others get their host's verdict. Hosts of which most
pages are allowed by rules are trusted seeds, those of which most are blocked are blocked seeds. Trust follows
links (a page that a trusted host links to is likelier good): personalised PageRank from the trusted seeds. Distrust
follows them backwards (who links to blocked hosts is suspect): the same from the blocked seeds on reversed
edges. Both run in Spark over the table of host edges, in one loop, until they have converged. A host is blocked if its distrust is at
least BLOCK_AT and more than its trust; without any evidence it is allowed.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed; null
html has no links; links within a host and relative ones aren't edges; repeated rows count each and get the same
verdict; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._spark import stored, table

#: (rule, verdict): a host and the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING = 0.85
#: Propagation ends when so small a share of the seeds' mass is on its way; steps between two tables that are written.
CLOSE, STEPS = 1e-6, 4
#: A seed starts with 1.
BLOCK_AT = 0.15


def host_of(url: F.Column) -> F.Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: F.Column, path: F.Column, rules: Sequence[tuple[str, str]] = RULES) -> F.Column:
    """The longest rule that fits, else null; equally long ones by their text."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: how often pages of one host link to another host; pages is (host, html)."""
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"), 1)).alias("dst"))
    dst = F.translate(F.col("dst"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return links.select(F.col("host").alias("src"), dst.alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, close: float = CLOSE) -> DataFrame:
    """host, trust, distrust; seeds is (host, trust, distrust) with 1.0 for seeds and 0.0 otherwise.

    Of what a host gets, the part `damping` goes on along its edges in proportion to their counts, until the mass on its way is
    under `close` of the seeds'. What reaches hosts without edges goes back to the seeds, which only scales all scores:
    so they add up to the number of seeds.
    """
    flow = edges.select("src", "dst", "n", F.lit("trust").alias("kind")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit("distrust").alias("kind")))
    out = flow.groupBy("src", "kind").agg(F.sum("n").alias("all"))
    flow = stored(flow.join(out, ["src", "kind"]).select("src", "kind", "dst", (F.col("n") / F.col("all") * damping).alias("share")))
    score = stored(seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trust").alias("x")), F.struct(F.lit("distrust").alias("kind"), F.col("distrust").alias("x")))).alias("e")).where("e.x > 0").select("host", "e.kind", F.col("e.x").alias("x")))
    start = {r.kind: r.x for r in score.groupBy("kind").agg(F.sum("x").alias("x")).collect()}  # two rows
    moving, left = score, 0 if flow.isEmpty() else sum(start.values())
    while left > close * sum(start.values()):
        steps = []
        for _ in range(STEPS):
            moving = flow.join(moving.withColumnRenamed("host", "src"), ["src", "kind"]).select(F.col("dst").alias("host"), "kind", (F.col("share") * F.col("x")).alias("x")).groupBy("host", "kind").agg(F.sum("x").alias("x"))
            steps.append(moving)
        told = steps[0].withColumn("last", F.lit(STEPS == 1))
        for k, x in enumerate(steps[1:], 2):
            told = told.unionByName(x.withColumn("last", F.lit(k == STEPS)))
        now = stored(told.groupBy("host", "kind").agg(F.sum("x").alias("x"), F.sum(F.when(F.col("last"), F.col("x"))).alias("moving")))
        after = stored(score.unionByName(now.select("host", "kind", "x")).groupBy("host", "kind").agg(F.sum("x").alias("x")))
        moving, score = now.where("moving > 0").select("host", "kind", F.col("moving").alias("x")), after
        left = moving.agg(F.sum("x")).first()[0] or 0
    whole = {r.kind: r.x for r in score.groupBy("kind").agg(F.sum("x").alias("x")).collect()}
    of = lambda kind: (F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("x"))), F.lit(0.0)) * (start[kind] / whole[kind] if kind in whole else 1.0)).alias(kind)
    return score.groupBy("host").agg(of("trust"), of("distrust"))


def judged(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """key, host, path, rule, verdict, trust and distrust of every row."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    base = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path"))
    verdict = dict(rules)
    ruled = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in verdict.items()], F.lit(None).cast("string"))
    hosts = ruled.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(by_rule == "allow").alias("good"), F.count_if(by_rule == "block").alias("bad"))
    seeds = hosts.select("host", F.when(F.col("good") * 2 > F.col("n"), 1.0).otherwise(0.0).alias("trust"), F.when(F.col("bad") * 2 > F.col("n"), 1.0).otherwise(0.0).alias("distrust"))
    scores = propagated(stored(host_edges(pages.select(host.alias("host"), F.col(html).alias("html")))), seeds)
    blocked = (F.col("distrust") >= BLOCK_AT) & (F.col("distrust") > F.col("trust"))
    found = ruled.join(scores, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    return found.select(key, "host", "path", "rule", F.coalesce(by_rule, F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
