"""Every registered query beside its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from rollcall.plans import load
from tools.check import TABLES, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(load()[0]) == set(load()[1])
    assert set(load()[0]) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(load()[0]))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
