"""A DataFrame as a read-only collection."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docframe.cursor import Cursor
from docframe.operators import frames


class Table:
    """Reads of ``df``; ``order_by`` names the columns that give its natural order."""

    def __init__(self, df: DataFrame, order_by: list[str] | None = None, **options):
        self._df, self._order, self._options = df, order_by, options

    def find(self, query: dict | None = None) -> Cursor:
        return frames.find(self._df, query, order_by=self._order, **self._options)

    def find_one(self, query: dict | None = None) -> dict | None:
        return self.find(query).limit(1).next()

    def count_documents(self, query: dict | None = None) -> int:
        return self.find(query).count()

    def distinct(self, field: str, query: dict | None = None, limit: int = frames.DISTINCT_LIMIT) -> list:
        return frames.distinct_limited(self._df, field, query, limit, order_by=self._order, **self._options)
