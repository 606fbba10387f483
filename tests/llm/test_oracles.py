"""Queries of the subpackage against their SQL."""

import duckdb
import pytest

from marram.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, small, name):
    folder = small.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, folder)
    assert sorted(want.columns) == sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in want.columns)) for r in got.collect())
    assert rows == sorted(map(repr, want.fetchall()))
