"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from arborkit import catalog

TABLES = "/root/testdata/sf0.001"


def canon(frame):
    cell = lambda x: "null" if x is None or x != x else repr(round(float(x), 5) + 0.0) if isinstance(x, int | float) else str(x)
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(cell, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(name, spark, duck):
    assert canon(catalog.queries()[name](spark, TABLES).toPandas()) == canon(duck.sql(catalog.oracle_sql()[name]).df())


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
