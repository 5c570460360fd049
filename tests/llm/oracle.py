"""Compares a query with its SQL in DuckDB."""

import glob
import os

import duckdb


def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}{'/*' if os.path.isdir(f) else ''}')")
    return c


def rows_of(c, sql):
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    return sorted((tuple(v for _, v in sorted(zip(names, r))) for r in cur.fetchall()), key=str), sorted(names)


def same(spark, name, sf_dir="/root/testdata/sf0.001"):
    from tessera.llm import queries

    df = queries.queries()[name](spark, sf_dir)
    want, names = rows_of(duck(sf_dir), queries.oracle_sql()[name])
    assert sorted(df.columns) == names
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, bad[:3]
