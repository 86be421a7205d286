"""Trees to Spark columns.

Negations are pushed to the leaves, so every column made here is TRUE where its condition holds
and FALSE or NULL elsewhere, and plain comparisons reach the file scan as pushed filters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docframe.query.ast import And, Nor, Not, Or

TRUE, FALSE = True, False


def all_of(parts: list) -> Column | bool:
    if any(p is FALSE for p in parts):
        return FALSE
    rest = [p for p in parts if p is not TRUE]
    return reduce(lambda a, b: a & b, rest) if rest else TRUE


def any_of(parts: list) -> Column | bool:
    if any(p is TRUE for p in parts):
        return TRUE
    rest = [p for p in parts if p is not FALSE]
    return reduce(lambda a, b: a | b, rest) if rest else FALSE


def lower(node, resolver, positive: bool = True) -> Column | bool:
    """Column that is TRUE where ``node`` matches, or with ``positive=False`` where it does not.

    Conditions known beforehand come as Python booleans.
    """
    if isinstance(node, And):
        parts = [lower(p, resolver, positive) for p in node.parts]
        return all_of(parts) if positive else any_of(parts)
    if isinstance(node, (Or, Nor)):
        wanted = positive == isinstance(node, Or)
        parts = [lower(p, resolver, wanted) for p in node.parts]
        return any_of(parts) if wanted else all_of(parts)
    if isinstance(node, Not):
        parts = [lower(p, resolver, not positive) for p in node.tests]
        return any_of(parts) if positive else all_of(parts)
    op = node.op
    if op in ("ne", "nin"):
        op, positive = op.removeprefix("n") if op == "nin" else "eq", not positive
    return resolver.field(node.field).test(op, node.value, positive)


def column(node, resolver) -> Column:
    found = lower(node, resolver)
    return F.lit(found) if isinstance(found, bool) else found
