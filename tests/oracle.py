"""Holds a query against its SQL in DuckDB, as multisets of rows."""

import glob
from collections import Counter

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in values)


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def check(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    r = connect(sf_dir).execute(sql)
    want = rows([d[0] for d in r.description], r.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in r.description)
    assert got == want
