"""Every query of the suite against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import suite

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(suite.oracle_sql()))
def test_query(spark, duck, name):
    df = suite.queries()[name](spark, SF)
    cur = duck.execute(suite.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    want = sorted((tuple(plain(v) for _, v in sorted(zip(names, r))) for r in cur.fetchall()), key=str)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(suite.queries()) - set(suite.oracle_sql())))
def test_rows_only(spark, name):
    assert suite.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
