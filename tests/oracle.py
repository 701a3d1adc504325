"""Runs DuckDB SQL on the same tables as a query."""

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


def difference(df, sql, sf_dir):
    """What rows of either side the other lacks; empty where both give the same."""
    cols, want = run(sql, sf_dir)
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, wanted {sorted(cols)}"
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    want = sorted(map(repr, want))
    if got == want:
        return ""
    a, b = set(got), set(want)
    return f"{len(got)} rows, wanted {len(want)}; only here {sorted(a - b)[:3]}, only there {sorted(b - a)[:3]}"
