"""Spark results against the same query in DuckDB."""

import glob
import os

import duckdb


def shown(v):
    if isinstance(v, float):
        return f"{v:.9g}" if v else "0"
    if hasattr(v, "asDict"):
        v = list(v)
    if isinstance(v, (list, tuple)):
        return str([shown(x) for x in v])
    return str(v)


def compare(spark, fn, sql: str, sf_dir: str) -> None:
    df = fn(spark, sf_dir)
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.sql(sql)
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    got = sorted([shown(r[c]) for c in order] for r in df.collect())
    assert got == sorted([shown(r[i]) for i in at] for r in want.fetchall())
