"""Comparison of a Spark result with DuckDB's, as sorted rows of normalised values."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def value(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.5f}".replace("-0.00000", "0.00000")
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in data)


def same(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(want)
    assert got == want
