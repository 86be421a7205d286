"""Lazy reads: a filtered DataFrame with an order and a slice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame

from docframe.errors import DocframeError
from docframe.sort import TOP, check_sort, in_order, sort_keys, without_first


def count_of(value, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise DocframeError(f"Cursor {name} must be a positive integer or zero.")
    return value


class Cursor:
    """Reads of one query; each modifier may be given before the first document is read."""

    def __init__(self, df: DataFrame, resolver, ties: list[Column], output: Callable[[DataFrame], DataFrame], decode: Callable):
        self._df, self._resolver, self._ties = df, resolver, ties
        self._output, self._decode = output, decode
        self._sort: dict | None = None
        self._skip, self._limit = 0, None
        self._rows: Iterator | None = None

    def sort(self, spec: dict) -> Cursor:
        self._sort = check_sort(spec)
        return self

    def skip(self, n: int) -> Cursor:
        self._skip = count_of(n, "skip")
        return self

    def limit(self, n: int) -> Cursor:
        self._limit = count_of(n, "limit")
        return self

    def to_df(self) -> DataFrame:
        """The documents as a lazy DataFrame; a sort with a limit plans as one top-k after skips up to ``TOP``."""
        df, skip, keys = self._df, self._skip, []
        if self._sort is not None or skip or self._limit is not None:
            keys = sort_keys(self._sort or {}, self._resolver, self._ties)
        if keys and skip and (self._limit is None or skip > TOP):
            df, skip = without_first(df, keys, skip), 0
            keys = keys if self._limit is not None else []
        if keys:
            df = df.orderBy(*in_order(keys))
        if skip:
            df = df.offset(skip)
        if self._limit is not None:
            df = df.limit(self._limit)
        return self._output(df)

    def count(self) -> int:
        """All matching documents, whatever the slice and the order."""
        return self._df.count()

    def __iter__(self) -> Iterator[dict]:
        return self

    def _ordered(self) -> DataFrame:
        if self._sort is None and self._ties and not self._skip and self._limit is None:
            return self._output(self._df.orderBy(*self._ties))
        return self.to_df()

    def __next__(self) -> dict:
        if self._rows is None:
            self._rows = iter(self._ordered().toLocalIterator())
        return self._decode(next(self._rows))

    def next(self) -> dict | None:
        return next(self, None)

    def to_list(self) -> list[dict]:
        """The documents that have not been read yet."""
        if self._rows is None:
            self._rows = iter(self._ordered().collect())
        return list(self)
