"""URL filters: fixed rules, then trust and distrust spread over the host graph.

Pages that a rule decides make their hosts seeds.  Trust flows from allowed seeds along edges,
distrust from blocked seeds against them, both as personalised PageRank; a host whose distrust
outweighs its trust is blocked, and so are its pages that no rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm.common import hot_hashes, let, materialise, salt_of, salts_of

#: (host, path prefix, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DAMPING = 0.85
ROUNDS = 12
#: Copies of a verdict that many pages look up.
SALTS = 16
#: Rounds between two cuts of the lineage.
CUT = 4
#: A host is blocked from this many times its trust, and a part of the mean share of a host on top.
RATIO = 2.0
FLOOR = 0.25
LINK = r"(?i)href\s*=\s*[\"']?[a-z][a-z0-9+.-]*://([^/?#\"'\s>]+)"


def lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def host_and_path(url: Column) -> Column:
    """``struct<host, path>``; both empty for a null url or one without ``://``."""
    empty = F.struct(F.lit("").alias("host"), F.lit("").alias("path"))

    def split(rest: Column) -> Column:
        host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
        path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^([^?#]*)", 1)
        return F.struct(lower(host).alias("host"), path.alias("path"))

    at = F.locate("://", url)
    return F.when(at > 0, let(F.substring(url, at + 3, F.length(url)), split)).otherwise(empty)


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(RULES, key=lambda r: len(r[0] + r[1])):  # the longest is asked last and wins
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts, and each host's link to its parent domain."""
    links = pages.where("host != ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", lower(F.col("dst")).alias("dst")).where("src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    hosts = pages.where("host != ''").select("host").distinct()
    parents = hosts.select(F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst")).where("src != dst and dst like '%.%'").withColumn("n", F.lit(1).cast("long"))
    return materialise(links.unionByName(parents).groupBy("src", "dst").agg(F.sum("n").alias("n")))


def spread(edges: DataFrame, seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """``host, score``: personalised PageRank from ``seeds`` (``host, weight`` summing to 1).

    ``edges`` is ``src, dst, n``.  A host without edges keeps what it is given; all scores add
    up to at most 1.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    shares = materialise(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")))
    base = materialise(nodes.join(seeds, "host", "left").select("host", F.coalesce("weight", F.lit(0.0)).alias("weight")))
    score = base.select("host", F.col("weight").alias("score"))
    for i in range(ROUNDS):
        moved = shares.join(score.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        score = base.join(moved, "host", "left").select("host", ((1 - DAMPING) * F.col("weight") + DAMPING * F.coalesce("got", F.lit(0.0))).alias("score"))
        if i % CUT == CUT - 1:
            score = materialise(score)
    return score


def judge_urls(pages: DataFrame) -> DataFrame:
    """Verdict per page, by rule or by its host's trust.

    A null url, or one without ``://``, has neither host nor path and is allowed; a null html
    has no links; repeated pages count each; an empty table gives no rows.
    """
    placed = pages.select("page_id", host_and_path(F.col("url")).alias("u"), "html").select("page_id", "u.host", "u.path", "html")
    name, verdict = rule_of(F.col("host"), F.col("path"))
    ruled = placed.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))
    hosts = materialise(ruled.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")))
    seeds = hosts.where("host != ''")
    edges = host_edges(placed)
    nodes = materialise(seeds.select("host").union(edges.select("src")).union(edges.select("dst")).distinct())
    totals = seeds.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    count = max(1, nodes.count())
    trust = spread(edges, seeds.where("good > 0").select("host", (F.col("good") / float(totals["good"] or 1)).alias("weight")), nodes)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread(back, seeds.where("bad > 0").select("host", (F.col("bad") / float(totals["bad"] or 1)).alias("weight")), nodes)
    blocked = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host").where(
        F.col("distrust") > RATIO * F.col("trust") + FLOOR / count).select("host", F.lit(True).alias("blocked"))
    # A host may hold a third of the pages: a page of such a host looks up one of several copies.
    hot = hot_hashes(hosts, "host", "pages")
    copies = materialise(blocked).withColumn("salt", F.explode(salts_of("host", hot, SALTS)))
    salted = ruled.withColumn("salt", salt_of("host", hot, SALTS, F.xxhash64("page_id", "path")))
    by_host = F.when(F.col("blocked"), "block").otherwise("allow")
    return salted.join(copies, ["host", "salt"], "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"))


def op4_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
