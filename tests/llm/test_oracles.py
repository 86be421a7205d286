"""The registered queries against their SQL in DuckDB, over whole tables."""

from __future__ import annotations

import duckdb
import pytest

from docframe.llm.oracles import ORACLES
from docframe.llm.queries import QUERIES
from tests.llm.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, found)) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
