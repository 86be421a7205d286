"""The read operators as functions on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.cursor import Cursor
from docframe.errors import DocframeError
from docframe.query.compile import compile_query
from docframe.query.lower import column, lower
from docframe.resolve import resolver_for

DISTINCT_LIMIT = 100


def find(df: DataFrame, query: dict | None = None, *, order_by: list[str] | None = None, doc_column: str | None = None, **options) -> Cursor:
    """Documents of ``df`` that match; ``order_by`` names the columns of the natural order."""
    resolver = resolver_for(df, doc_column, **options)
    found = lower(compile_query(query), resolver)
    rows = df if found is True else df.where(F.lit(False) if found is False else found)
    return Cursor(rows, resolver, [F.col(c) for c in order_by or []], lambda x: x, lambda row: row.asDict(recursive=True))


def matching(df: DataFrame, query: dict | None, name: str = "matched", *, doc_column: str | None = None, **options) -> DataFrame:
    """``df`` with a boolean column that is never NULL."""
    return df.withColumn(name, F.coalesce(column(compile_query(query), resolver_for(df, doc_column, **options)), F.lit(False)))


def count_documents(df: DataFrame, query: dict | None = None, **options) -> DataFrame:
    """One row ``n``."""
    return find(df, query, **options).to_df().agg(F.count(F.lit(1)).alias("n"))


def distinct(df: DataFrame, field: str, query: dict | None = None, *, order_by: list[str] | None = None, doc_column: str | None = None, **options) -> DataFrame:
    """Distinct present values as ``value``, in the order first seen if ``order_by`` is given."""
    resolver = resolver_for(df, doc_column, **options)
    target = resolver.field(field)
    if target.value is None:
        return df.limit(0).select(F.lit(None).cast("string").alias("value"))
    rows = find(df, query, doc_column=doc_column, **options).to_df()
    if not getattr(target, "null_is_value", False):
        rows = rows.where(target.value.isNotNull())
    first: list[Column] = [F.min(F.struct(*order_by)).alias("first")] if order_by else []
    groups = rows.select(target.distinct_key().alias("key"), target.value.alias("value"), *(order_by or [])).groupBy("key").agg(F.first("value").alias("value"), *first)
    return (groups.orderBy("first") if order_by else groups).select("value")


def distinct_limited(df: DataFrame, field: str, query: dict | None = None, limit: int = DISTINCT_LIMIT, **options) -> list:
    """Distinct values as a list; more than ``limit`` of them are an error."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise DocframeError("distinct() limit must be a positive integer.")
    rows = distinct(df, field, query, **options).limit(limit + 1).collect()
    if len(rows) > limit:
        raise DocframeError(f'Too many distinct values for field "{field}" (limit: {limit}).')
    return [r["value"] for r in rows]


def duplicates(df: DataFrame, field: str, kind: str, **options) -> DataFrame:
    """Values of index type ``kind`` that several documents share: ``value, n``."""
    target = resolver_for(df, **options).field(field)
    typed = target.test("type", (kind,), True)
    rows = df.where(F.lit(typed) if isinstance(typed, bool) else typed)
    return rows.groupBy(target.value.alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
