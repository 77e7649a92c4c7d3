"""Queries that SQL can express give DuckDB's rows."""

import duckdb
import pytest

from nearfield.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    at = [want.columns.index(x) for x in columns]
    assert sorted(str(tuple(r[x] for x in columns)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
