"""Sort specifications, and orders without their first rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.errors import DocframeError

MOST_FIELDS = 4
TOP = 10_000  # rows that one task may hold to find the last of them

Keys = list[tuple[Column, int]]  # with 1 for ascending, -1 for descending


def check_sort(spec: dict) -> dict:
    if not spec:
        raise DocframeError("Sort specification must contain at least one field.")
    if len(spec) > MOST_FIELDS:
        raise DocframeError(f"Sort specification cannot exceed {MOST_FIELDS} fields (got {len(spec)}).")
    for name, direction in spec.items():
        if not name:
            raise DocframeError("Sort field name cannot be empty.")
        if isinstance(direction, bool) or direction not in (1, -1):
            raise DocframeError(f'Sort direction must be 1 (ascending) or -1 (descending), got {direction} for field "{name}".')
    return dict(spec)


def sort_keys(spec: dict, resolver, ties: list[Column]) -> Keys:
    """Keys of ``spec``: missing and null lowest, then booleans, numbers, strings; ties last."""
    return [(key, direction) for name, direction in spec.items() for key in resolver.field(name).sort_keys(name)] + [(t, 1) for t in ties]


def in_order(keys: Keys) -> list[Column]:
    return [key.asc_nulls_first() if direction == 1 else key.desc_nulls_last() for key, direction in keys]


def _same(keys: Keys, place: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, (key.eqNullSafe(p) for (key, _), p in zip(keys, place)))


def _not_before(keys: Keys, place: list[Column]) -> Column:
    """Whether ``keys`` are at ``place`` or after it in their order."""
    out = F.lit(True)
    for (key, direction), p in reversed(list(zip(keys, place))):
        past = F.coalesce(key > p, p.isNull() & key.isNotNull()) if direction == 1 else F.coalesce(key < p, key.isNull() & p.isNotNull())
        out = past | (key.eqNullSafe(p) & out)
    return out


def _ranged(df: DataFrame, keys: Keys) -> DataFrame:
    """``df`` in order; rows of the same keys share a partition, however ``df`` was dealt before."""
    return df.repartitionByRange(*in_order(keys)).sortWithinPartitions(*in_order(keys))


def _last_of(df: DataFrame, keys: Keys, n: int) -> DataFrame:
    """The keys of row ``n`` as ``k0``, ``k1``, ... and how many of the first ``n`` rows have them, ``d``.

    No row if there are fewer than ``n`` beyond ``TOP``; up to ``TOP``, then the keys of the last row.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows, own = df.select(*(key.alias(k) for (key, _), k in zip(keys, names))), [(F.col(k), direction) for k, (_, direction) in zip(names, keys)]
    if n <= TOP:
        first = rows.orderBy(*in_order(own)).limit(n)
        return first.groupBy(*names).agg(F.count(F.lit(1)).alias("d")).orderBy(*(c.desc_nulls_last() if d == 1 else c.asc_nulls_first() for c, d in own)).limit(1)
    # Which range of the order has row n, then which of the keys in that range.
    at = F.monotonically_increasing_id().alias("at")
    ranges = _ranged(rows, own).select(F.struct(*names).alias("k"), at).groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min_by("k", "at").alias("lo"), F.max_by("k", "at").alias("hi"))
    to = F.sum("n").over(Window.orderBy("part"))
    one = ranges.select("lo", "hi", to.alias("to"), (to - F.col("n")).alias("before")).where((F.col("before") < n) & (F.col("to") >= n)).drop("to")
    lo, hi = ([F.col(f"{end}.{k}") for k in names] for end in ("lo", "hi"))
    inside = rows.crossJoin(F.broadcast(one)).where(_not_before(own, lo) & (_same(own, hi) | ~_not_before(own, hi)))
    counts = inside.groupBy(*names, "before").agg(F.count(F.lit(1)).alias("n"))
    to = F.col("before") + F.sum("n").over(Window.orderBy(*in_order(own)))
    return counts.select(*names, to.alias("to"), (F.lit(n) - to + F.col("n")).alias("d")).where((F.col("to") >= n) & (F.col("d") > 0)).drop("to")


def without_first(df: DataFrame, keys: Keys, n: int) -> DataFrame:
    """``df`` in the order of ``keys`` without its first ``n`` rows.

    An offset would send all rows through one task.  Here one task finds the keys of row ``n`` and
    rows before them are filtered out; rows at them come first in their partition, so those among
    the first ``n`` are known by their position there.
    """
    place, drop, at = (f"{name}{'_' * max(map(len, df.columns))}" for name in ("place", "drop", "at"))
    last = _last_of(df, keys, n)
    found = [F.col(f"{place}.k{i}") for i in range(len(keys))]
    rest = df.crossJoin(F.broadcast(last.select(F.struct("*").alias(place)))).where(_not_before(keys, found))
    rest = rest.withColumn(drop, F.when(_same(keys, found), F.col(f"{place}.d")).otherwise(0)).drop(place)
    numbered = _ranged(rest, keys).withColumn(at, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    return numbered.where(F.col(at) >= F.col(drop)).drop(at, drop)
