"""Runs a query's DuckDB SQL on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}/*.parquet'" if os.path.isdir(path) else f"create view {t} as select * from '{path}'")
    rel = con.sql(sql)
    return list(rel.columns), rel.fetchall()


def same(df, sql, sf_dir):
    cols, want = run(sql, sf_dir)
    assert sorted(cols) == sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
