"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.  All but
the last return the columns of ``docs``, whatever these are called.  Rows are told apart by their
``doc_id`` and a 64-bit hash of it and the text, so stages need no unique or non-null ids; rows equal
in both share every verdict.  Null and empty texts have no words; texts may be of any length that a row can
hold; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm import decontamination, jaccard, pii, quality, tokenising
from docframe.llm.common import materialise

#: Bytes of words that a worker remembers while encoding; a stage shares its executor with those before.
MEMORY = 12 << 20


def free_name(docs: DataFrame) -> str:
    """A name for the row's key that no column of ``docs`` has, in any case."""
    name, taken = "_row_of_stage", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def pair(row: Column) -> Column:
    """A row's key: its hash and its id, which may be null and then equals another null."""
    return F.struct(row.alias("row"), F.col("doc_id").cast("long").alias("id"))


def with_key(docs: DataFrame, key: str) -> DataFrame:
    return docs.withColumn(key, pair(F.xxhash64("doc_id", F.coalesce("text", F.lit("")))))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``rows`` (``doc_id, row``).

    The keys are sent to all executors while they are few; beyond, both sides are shuffled.
    """
    key = free_name(docs)
    gone = decontamination.small(materialise(rows.select(pair(F.col("row")).alias(key)).distinct()))
    return with_key(docs, key).join(gone, key, "left_anti").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or whose host fails too often.

    Documents without words fail; a null source is a host of its own.
    """
    return without(docs, quality.judge(docs).where(~F.col("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the least id, and of equal ids the least key.

    Documents without words belong to no group and stay; of equal rows one stays; a null id comes
    after all others.
    """
    found = materialise(jaccard.linked_components(docs).where(F.col("n_shingles") > 0))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = found.groupBy("label").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("label", F.struct("first.row", F.col("first.doc_id").alias("id")).alias("first"))
    gone = found.join(decontamination.small(materialise(first)), "label").where(~pair(F.col("row")).eqNullSafe(F.col("first")))
    rest = without(docs, gone)
    again = materialise(found.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "row"))
    if not again.take(1):
        return rest
    key = free_name(docs)
    keyed, twice = with_key(rest, key), again.select(pair(F.col("row")).alias(key))
    once = keyed.join(twice, key, "left_semi").dropDuplicates([key])
    return keyed.join(twice, key, "left_anti").select(*docs.columns).union(once.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which windows of at least two benchmark items occur; an empty benchmark drops none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontamination.contamination(docs, benchmark, width=None).where("contaminated"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind; null texts stay null."""
    return pii.redact(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of every text that is left, and a digest of their decoding; null texts have no pieces."""
    return tokenising.with_tokens(docs, memory=MEMORY)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("pii", mask_private),
    ("sentencepiece", tokenise),
]

#: SQL cannot express byte-pair encoding or the span classifier; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
