"""Every registered query against its SQL in DuckDB, on the same Parquet tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from contentflow.workload import QUERIES, SQL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SPARK_TO_SQL = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck(testdata):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{testdata}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, testdata, name):
    sql = entry.oracle_sql()[name]
    df = entry.queries()[name](spark, testdata)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    relation = duck.sql(sql)
    assert sorted(relation.columns) == columns
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: SPARK_TO_SQL.get(t, t) for c, t in df.dtypes} == types
    order = ", ".join(f'"{c}"' for c in columns)
    want = [tuple(map(plain, r)) for r in duck.sql(f"SELECT {order} FROM ({sql})").fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
