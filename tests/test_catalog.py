"""Every registered query against its DuckDB SQL on the smallest data set."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.check import rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert got == rows_of(rel.columns, rel.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
