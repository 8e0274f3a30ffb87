"""A query's rows beside those of its SQL in DuckDB."""

import math

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(clean(r[i])) for i in order) for r in found)


def by_sql(sql, data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def same(df, sql, data=DATA):
    columns, want = by_sql(sql, data)
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, want)
