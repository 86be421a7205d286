"""Quality rules with host-level verdicts (DataFrame functions only).

Rules are judged per document, failures are summed per host, each host's failure rate is
shrunk towards the corpus by a beta prior fitted to all hosts, and the host verdicts are
joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm.common import documents, hot_hashes, let, materialise, salt_of, salts_of, words_of

WINDOW = 8
SALTS = 32


def repeated_words(words: Column) -> Column:
    """Words inside a window of ``WINDOW`` words that occurs at least twice in the text."""

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def starts(s: Column) -> Column:
            last = F.size(s) - 1
            twin = F.filter(F.sequence(F.lit(0), last), lambda k: (F.get(s, k - 1)["h"] == s[k]["h"]) | (F.get(s, k + 1)["h"] == s[k]["h"]))
            return F.sort_array(F.transform(twin, lambda k: s[k]["p"]))

        def total(p: Column) -> Column:
            return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                               lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")))["n"]

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(ordered, starts), total))

    def hashes(w: Column) -> Column:
        n = F.size(w)
        return F.when(n <= WINDOW, F.lit(0)).otherwise(
            let(F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW))), covered))

    return let(words, hashes)


def measures(df: DataFrame, keep: list[str]) -> DataFrame:
    """The base counts of every document; ``keep`` names the columns carried along."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def counts(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                        let(lines, F.size).cast("long").alias("n_lines"),
                        repeated_words(w).cast("long").alias("n_repeat_words"))

    return df.select(*keep, let(words_of(F.col("text")), counts).alias("m")).select(*keep, "m.*")


def with_failures(m: DataFrame) -> DataFrame:
    """``base_failed`` by the base rules; ``failed`` by any rule, as hosts are judged."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    more = (100 * F.col("n_symbols") > 20 * F.col("word_chars")) | (100 * F.col("n_dup_lines") > 50 * F.col("n_lines"))
    return m.withColumn("base_failed", base).withColumn("failed", base | more)


def host_verdicts(judged: DataFrame, host: str, threshold: float) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, ``host_kept``.

    The prior is fitted by moments over hosts weighted by size: mean ``m`` and the variance
    beyond binomial noise give its strength.  Without such variance all hosts share one rate.
    """
    hosts = judged.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("bad"))
    hosts = materialise(hosts)
    r = F.col("bad") / F.col("n")
    s = hosts.agg(F.sum("n").alias("docs"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * r * r).alias("sq"),
                  F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")).first()
    mean = (s["bad"] or 0) / s["docs"] if s["docs"] else 0.0
    strength = 1e6
    if s["docs"] and s["k"] > 1 and 0 < mean < 1:
        spread = s["sq"] - s["docs"] * mean**2  # sum of n (r - mean)^2
        size = s["docs"] - s["nn"] / s["docs"]
        between = max(0.0, (spread - (s["k"] - 1) * mean * (1 - mean)) / size) if size > 0 else 0.0
        if between > 0:
            strength = min(1e6, max(1.0, mean * (1 - mean) / between - 1))
    shrunk = (F.col("bad") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select(host, F.col("n").alias("host_docs"), F.col("bad").alias("host_failures"), shrunk.alias("host_rate"), (shrunk <= threshold).alias("host_kept"))


def judge(df: DataFrame, host: str = "source", threshold: float = 0.5) -> DataFrame:
    """Base counts and verdicts per document.

    Null texts have no words; a null host is a host of its own; repeated rows are judged
    each; an empty table gives no rows.  ``kept`` is false where the base rules fail or the
    host's shrunk failure rate exceeds ``threshold``.
    """
    row = F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))
    named = df.select("doc_id", "text", row.alias("row"), F.struct(F.col(host).isNull().alias("none"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("name")).alias("host_key"))
    judged = materialise(with_failures(measures(named, ["doc_id", "row", "host_key"])))
    verdicts = host_verdicts(judged, "host_key", threshold)
    # A host may hold a third of all rows: the documents of such hosts are spread over SALTS copies of its verdict.
    hot = hot_hashes(verdicts, "host_key", "host_docs")
    spread = verdicts.withColumn("salt", F.explode(salts_of("host_key", hot, SALTS)))
    salted = judged.withColumn("salt", salt_of("host_key", hot, SALTS, F.col("row")))
    return salted.join(spread, ["host_key", "salt"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"), "host_docs", "host_failures", "host_rate", "row")


def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
