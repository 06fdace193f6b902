import os

import duckdb
import pytest

import __spark_entry__ as entry
from larkspur.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def key(row):
    return tuple("none" if x is None else round(float(x), 3) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((key(tuple(r[c] for c in columns)) for r in df.collect()), key=str) == sorted((key(tuple(r[i] for i in at)) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(entry.queries())
