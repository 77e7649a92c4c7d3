"""Every query with SQL gives DuckDB's rows over the smallest tables."""

import duckdb
import pytest

from nearfield.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert got == sorted(str(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
    assert got


def exact_keys(spark):
    """The ten nearest of the queries' vector, by numpy."""
    import numpy as np

    got = spark.read.parquet(f"{SF}/embeddings.parquet").where("embedding IS NOT NULL").collect()
    x = np.array([r["embedding"] for r in got], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[[r["vec_id"] for r in got].index(0)]
    return {got[i]["vec_id"] for i in np.argsort(-(x @ q), kind="stable")[:10]}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_sql(spark, name):
    """What SQL can't say is held against brute force, or a bound."""
    rows = registry.QUERIES[name](spark, SF).collect()
    assert rows
    if name.endswith("_recall"):
        assert rows[0]["recall"] >= 0.9 and rows[0]["average_degree"] > 1
    elif name in ("pq_search", "polar_search", "subspace_search"):
        assert len({r["vec_id"] for r in rows} & exact_keys(spark)) >= 9
    elif name == "codec_errors":
        assert {r["codec"] for r in rows} == {"pq", "polar", "subspace"} and all(0 < r["error"] < 0.5 for r in rows)
    elif name == "embed_search":
        assert rows[0]["rank"] == 1 and rows[0]["score"] == 1.0 and 0 in {r["doc_id"] for r in rows if r["score"] == 1.0}
    else:
        raise AssertionError(f"{name} has neither SQL nor a check")
