"""Every registered query of the engine against its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from docframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.ORACLES:
        found = duck.execute(catalog.ORACLES[name])
        want = table([c[0] for c in found.description], found.fetchall())
        assert got[0] == want[0] and len(got[1]) == len(want[1]) and got[1] == want[1]


@pytest.mark.parametrize("name, source, skip", [("sort_multi", "customer", 0), ("sort_nulls", "lineitem", 0), ("sort_nulls_desc", "lineitem", 10)])
def test_whole_tables_are_sorted(spark, duck, name, source, skip):
    df = catalog.QUERIES[name](spark, SF)
    got, found = df.collect(), duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert [tuple(plain(r[c]) for c in columns) for r in got] == [plain(r) for r in found.fetchall()]
    assert len(got) == duck.execute(f"SELECT count(*) FROM {source}").fetchone()[0] - skip
    if "flag" in columns:
        assert {r["flag"] is None for r in got} == {True, False}
