"""Registered queries against DuckDB on the smallest tables."""

import os

import pytest

from relift.catalogue import FOUND

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if x is None or type(x).__name__ in ("NaTType", "NAType") or x != x:
        return None
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return float(x) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "if" else str(x)


def _rows(df):
    return sorted((tuple(map(_cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(FOUND))
def test_query(spark, duck, name):
    run, sql = FOUND[name]
    got, want = run(spark, SF).toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)
