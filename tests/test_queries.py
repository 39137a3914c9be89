"""Every registered query against its SQL in an independent engine."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from labelspark.queries import QUERIES as BASE

SF = "/root/testdata/sf0.001"

# the queries of the language-model subpackage have their own tests
QUERIES, SQL = {k: q for k, q in entry.queries().items() if k in BASE}, {k: q for k, q in entry.oracle_sql().items() if k in BASE}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def test_catalogue():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), want.columns)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 2 and rows[0]["threshold"] == rows[1]["threshold"]
