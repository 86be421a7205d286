"""Sharding by a Feistel permutation over global row numbers (DataFrame functions only).

Every row gets a global number, the permutation scatters the numbers over the same range, and
shard and slot are the remainder and quotient of the scattered number.  Any row's place can be
computed from its number alone, the shuffle is reproducible, and counts differ by at most one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docframe.llm.common import documents, let, materialise

PRIME = 2_147_483_647  # products of two residues stay below 2**62
ROUNDS = 6
BUCKETS = 4096
#: Copies of one row that a task deals out at once.
STRETCH = 1 << 16
#: Bound on the numbers outside the range that the permutation can walk through.
MAX_WALK = 7


def grid(n: int) -> tuple[int, int]:
    """Sides ``a <= b`` of the permutation's grid, with ``n <= a * b <= n + MAX_WALK``.

    A walk leaves the range at most ``a * b - n`` times in a row, so this bounds its length.
    About one side in ``a / MAX_WALK`` fits, so few are tried.
    """
    a = max(1, math.isqrt(max(n - 1, 0)))
    while (-n) % a > MAX_WALK:
        a += 1
    return a, max(1, -(-n // a))


def scramble(x: Column, key: int) -> Column:
    """Round function: a keyed hash of a residue, in exact 64-bit arithmetic."""
    c = [(key * 48_271 + 1_013_904_223 * (i + 1)) % PRIME for i in range(3)]
    t = (x + F.lit(c[0])) % PRIME
    t = (t * (t % F.lit(1_000_003) + F.lit(c[1]))) % PRIME
    return (t * F.lit(c[2] | 1) + F.shiftright(t, 15)) % PRIME


def permute(x: Column, n: int, seed: int = 0) -> Column:
    """Bijection of ``0 .. n-1``: Feistel rounds on a grid, walked until inside the range."""
    a, b = grid(n)

    def halves(left: Column, right: Column) -> Column:
        return F.struct(left.alias("l"), right.alias("r"))

    def turn(i: int):
        key = seed * ROUNDS + i + 1
        if i % 2 == 0:
            return lambda s: halves((s["l"] + scramble(s["r"], key)) % a, s["r"])
        return lambda s: halves(s["l"], (s["r"] + scramble(s["l"], key)) % b)

    def one_pass(v: Column) -> Column:
        state = halves(F.call_function("div", v, F.lit(b)), v % b)
        for i in range(ROUNDS):
            state = let(state, turn(i))
        return let(state, lambda s: s["l"] * b + s["r"])

    def step(s: Column) -> Column:
        moved = let(one_pass(s["v"]), lambda v: F.struct(v.alias("v"), (v < n).alias("done")))
        return F.when(s["done"], s).otherwise(moved)

    walks = F.sequence(F.lit(0), F.lit(a * b - n))
    start = F.struct(x.cast("long").alias("v"), F.lit(False).alias("done"))
    return F.aggregate(walks, start, lambda s, _: step(s))["v"]


def number_rows(df: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Give rows the numbers 0, 1, ... in a fixed order; return them and their count.

    Rows go to hashed buckets; the numbers before a bucket come from the counts of the
    buckets (at most ``BUCKETS`` of them).  Equal rows are counted before they are dealt out,
    so a row repeated any number of times is one row in its bucket; equal rows get successive
    numbers.  ``keys`` must be all columns of ``df``.  A row with more than ``STRETCH`` copies is
    dealt out by many tasks, a stretch of numbers each.
    """
    counted = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket"), *keys).agg(F.count(F.lit(1)).alias("copies"))
    counted = materialise(counted)
    sizes = counted.groupBy("bucket").agg(F.sum("copies").alias("n"))
    before = sizes.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    inside = Window.partitionBy("bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("within", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    first = F.col("before") + F.col("within")
    placed = placed.join(F.broadcast(before), "bucket").select(*keys, first.alias("first"), "copies")  # at most BUCKETS rows
    if counted.where(F.col("copies") > STRETCH).take(1):
        stretches = F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("copies") - 1, F.lit(STRETCH)))
        dealt = placed.where(F.col("copies") > STRETCH).select("*", F.explode(stretches).alias("i")).select(
            *keys, (F.col("first") + F.col("i") * STRETCH).alias("first"), F.least(F.lit(STRETCH).cast("long"), F.col("copies") - F.col("i") * STRETCH).alias("copies"))
        placed = placed.where(F.col("copies") <= STRETCH).union(dealt.repartition("first"))
    rows = placed.select(*keys, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("row_number"))
    return rows, total


def shard(df: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """Place documents into ``shards`` shards under the law ``rows``.

    ``document`` holds all columns of the row, beside its place and the digest of its text.
    Needs ``doc_id`` and ``text``, and columns that can be grouped and ordered.  A null text
    counts as empty, a null ``doc_id`` is a value like any other, repeated rows each get a
    place, an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = df.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.struct(*df.columns).alias("document"))
    rows, total = number_rows(whole, ["doc_id", "size", "text_crc32", "document"])
    if total == 0:
        place = F.lit(0).cast("long")
    else:
        place = permute(F.col("row_number"), total, seed)
    return rows.withColumn("place", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), F.lit(shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number", "document")


def write_shards(df: DataFrame, path: str, shards: int = 40, seed: int = 0) -> None:
    """Write the rows of ``df`` (``slot, document``) as Parquet, a folder to a shard, in the order of slots."""
    placed = shard(df, shards, seed).select("shard", "slot", "document")
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).drop("document")
