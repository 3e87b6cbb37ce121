"""Every registered query against its SQL, as the same rows with the same names."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from workload.catalog import ORACLES, QUERIES

DATA = os.environ.get("GRIDMILL_TEST_DATA", "/root/testdata/sf0.01")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        table = name.removesuffix(".parquet")
        connection.execute(f"create view {table} as select * from '{DATA}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float):
        return value + 0.0
    return value.isoformat() if isinstance(value, dt.datetime) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = (tuple(plain(row[i]) for i in order) for row in rows)
    return [columns[i] for i in order], sorted(cells, key=repr)


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    df = QUERIES[name](spark, DATA)
    result = engine.execute(ORACLES[name])
    expected = table([c[0] for c in result.description], result.fetchall())
    assert table(df.columns, df.collect()) == expected
    assert expected[1]
