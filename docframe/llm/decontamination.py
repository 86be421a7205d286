"""Benchmark decontamination by a positional inverted index (DataFrame functions only).

The index stores a posting (document row, term, position) for every training token whose term
the benchmark uses, plus an end marker at the document's length.  A phrase is looked up from
its rarest terms: their lists, each shifted by the term's offset in the phrase, are intersected
first; only documents that survive are compared at the other offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docframe.llm.common import ascii_lower, documents, materialise

GRAM = 8
#: Words within which all distinct terms of an item make a proximity match.
WIDTH = 100
NOT_TERM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: No term is empty, so the empty one marks a document's end.
END = ""
#: Rows, and bytes of texts and lists, up to which a side of a join is sent to all executors; beyond, both are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
FIXED_WIDTH = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp")


def terms_of(text):
    """Words of a text after lower-casing A-Z; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_TERM), lambda w: w != "")


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its rows and their bytes, counted here, are few enough."""
    wide = [F.coalesce(F.octet_length(F.col(c) if t == "string" else F.to_json(F.col(c))), F.lit(0)) for c, t in df.dtypes if t not in FIXED_WIDTH]
    size = sum(wide, F.lit(0).cast("long"))
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= BROADCAST_ROWS and found["bytes"] <= BROADCAST_BYTES else df


@dataclass
class Phrases:
    """Benchmark phrases: their terms by offset, and the items that have them."""

    terms: DataFrame  # wid, n, off, term
    items: DataFrame  # wid, item_id


def phrases_of(benchmark: DataFrame, gram: int = GRAM) -> Phrases:
    """Distinct windows of ``gram`` words; a shorter item is one window, an empty one has none."""
    found = (
        benchmark.select("item_id", terms_of(F.col("text")).alias("w"))
        .where(F.size("w") > 0)
        .select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - gram + 1))).alias("at"))
        .select("item_id", F.slice("w", F.col("at"), gram).alias("terms"))
        .distinct()
    )
    found = materialise(found)
    numbered = materialise(found.select("terms").distinct().withColumn("wid", F.monotonically_increasing_id()))
    items = materialise(found.join(numbered, "terms").select("wid", "item_id"))
    return Phrases(materialise(numbered.select("wid", F.size("terms").alias("n"), F.posexplode("terms").alias("off", "term"))), items)


def index_of(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings ``row, doc_id, term, pos`` of the vocabulary's terms, and an end marker a document.

    Rows equal in ``doc_id`` and ``text`` share one ``row``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = docs.select(F.xxhash64("doc_id", text).alias("row"), "doc_id", F.posexplode(F.concat(terms_of(F.col("text")), F.array(F.lit(END)))).alias("pos", "term"))
    wanted = vocabulary.select("term").union(vocabulary.sparkSession.range(1).select(F.lit(END).alias("term"))).distinct()
    return materialise(tokens.join(small(wanted), "term", "left_semi").select("row", "doc_id", "term", "pos"))


def lengths(index: DataFrame) -> DataFrame:
    """``term, postings``: how long each list is."""
    return materialise(index.groupBy("term").agg(F.count(F.lit(1)).alias("postings")))


def exact_matches(index: DataFrame, phrases: Phrases, counts: DataFrame) -> DataFrame:
    """Every occurrence ``row, wid, start, n`` of every phrase; ``counts`` has the lists' lengths."""
    ranked = materialise(
        phrases.terms.join(small(counts), "term").withColumn("rank", F.row_number().over(Window.partitionBy("wid").orderBy("postings", "off")))
        .withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("wid")))
        .where(F.col("known") == F.col("n"))  # a term without postings rules its phrase out
    )

    def shifted(rank: int) -> DataFrame:
        """Starts that the ``rank``-th rarest term of each phrase allows."""
        lists = ranked.where(F.col("rank") == rank).select("wid", "n", "off", "term")
        return index.join(small(lists), "term").where(F.col("pos") >= F.col("off")).select("row", "wid", "n", (F.col("pos") - F.col("off")).alias("start"))

    rarest = shifted(1)
    both = rarest.where("n > 1").join(shifted(2), ["row", "wid", "n", "start"], "left_semi")
    starts = materialise(both.union(rarest.where("n = 1")).distinct())
    rest = ranked.where("rank > 2").select("wid", "off", "term")
    expected = starts.where("n > 2").join(small(rest), "wid").select("row", "wid", "n", "start", (F.col("start") + F.col("off")).alias("pos"), "term")
    held = index.join(small(starts.where("n > 2").select("row").distinct()), "row", "left_semi").select("row", "pos", "term").distinct()
    full = expected.join(held, ["row", "pos", "term"]).groupBy("row", "wid", "n", "start").agg(F.count(F.lit(1)).alias("met")).where("met = n - 2")
    return full.select("row", "wid", "start", "n").union(starts.where("n <= 2").select("row", "wid", "start", "n"))


def proximity_matches(index: DataFrame, benchmark: DataFrame, counts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Places ``row, item_id, start`` from which all distinct terms of an item occur within ``width`` words.

    Only documents that hold an item's rarest term are looked at.
    """
    wanted = benchmark.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    wanted = materialise(wanted.withColumn("needed", F.count(F.lit(1)).over(Window.partitionBy("item_id"))).where(F.col("needed") <= width))
    rare = wanted.join(small(counts), "term").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("postings", "term")))
    rare = rare.withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("item_id"))).where("rank = 1 AND known = needed").select("item_id", "term")
    near = materialise(index.join(small(materialise(rare)), "term").select("row", "item_id").distinct())
    there = index.join(small(materialise(near.select("row").distinct())), "row", "left_semi")
    postings = there.join(small(wanted), "term").join(small(near), ["row", "item_id"], "left_semi").select("row", "item_id", "needed", "term", "pos").distinct()
    ahead = Window.partitionBy("row", "item_id").orderBy("pos").rangeBetween(0, width - 1)
    return postings.withColumn("seen", F.size(F.collect_set("term").over(ahead))).where("seen = needed").select("row", "item_id", F.col("pos").alias("start"))


def contamination(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, least_items: int = 2, width: int | None = WIDTH) -> DataFrame:
    """Words hit and items found per document; ``n_near`` items have a proximity match.

    Without ``width``, proximity is not looked at and ``n_near`` is null.

    A document is contaminated if windows of at least ``least_items`` items occur in it.  Null
    and empty texts have no words; null ids are ids like any other; repeated rows get equal
    results; an empty benchmark hits nothing.  A document with a null ``item_id`` among its
    items ignores that item.  Other columns are left out, whatever their names; texts may be of
    any length that a row can hold.
    """
    benchmark = benchmark.where(F.col("item_id").isNotNull())
    phrases = phrases_of(benchmark, gram)
    index = index_of(docs, phrases.terms)
    counts = lengths(index)
    matches = materialise(exact_matches(index, phrases, counts))
    near = None if width is None else proximity_matches(index, benchmark, counts, width).groupBy("row").agg(F.count_distinct("item_id").alias("n_near"))
    items = matches.select("row", "wid").distinct().join(small(phrases.items), "wid").groupBy("row").agg(
        F.collect_set(F.col("item_id").cast("string")).alias("items"))

    def cover(spans):
        """Words under spans sorted by start."""
        return F.aggregate(spans, F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")), lambda a, s: F.struct(
            (a["hit"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"]))).alias("hit"),
            F.greatest(a["end"], s["start"] + s["n"]).alias("end")))["hit"]

    hits = matches.select("row", "start", "n").distinct().groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans"))
    found = items.join(hits, "row").select("row", F.col("items"), cover(F.col("spans")).cast("long").alias("n_hit"))
    found = found.withColumn("n_near", F.lit(None).cast("long")) if near is None else found.join(near.select("row", "n_near"), "row", "full")
    ids = F.coalesce(F.array_sort("items"), F.array().cast("array<string>"))
    return index.where(F.col("term") == END).join(small(materialise(found)), "row", "left").select(
        "doc_id", F.col("pos").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size(ids) >= least_items).alias("contaminated"), (F.coalesce("n_near", F.lit(0)) if near is not None else F.col("n_near")).cast("long").alias("n_near"), "row")


def op3_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
