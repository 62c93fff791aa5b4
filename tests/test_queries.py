"""Every graph query against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from wayfarer.plans import queries as q

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = q.QUERIES[name](spark, sf).toPandas(), duck.execute(q.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (d[columns].astype("float64").sort_values(columns).reset_index(drop=True) for d in (got, want))
    assert got.equals(want)


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert set(q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
