"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

from wavemill import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in TABLES:
        c.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return c


def key(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(key, v))
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(key(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in Q.ORACLES:
        assert rows
        return
    rel = duck.sql(Q.ORACLES[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert rows == sorted((tuple(key(r[i]) for i in at) for r in rel.fetchall()), key=repr)
