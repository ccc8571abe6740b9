"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from annalist.catalog.oracles import ORACLES
from annalist.catalog.queries import REGISTRY
from check import TABLES, rows_of

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert len(got) > 0
    if name in entry.oracle_sql():
        want = con.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLES)
