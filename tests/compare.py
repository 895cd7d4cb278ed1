"""Rows of a Spark query and of its SQL in DuckDB, in one form."""

import glob
import os

import duckdb


def connect(sf):
    c = duckdb.connect()
    for f in sorted(glob.glob(f"{sf}/*.parquet")):
        at = f"{f}/*.parquet" if os.path.isdir(f) else f
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{at}'")
    return c


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if v != v else float(v) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def both(spark, sf, run, sql):
    df = run(spark, sf)
    c = connect(sf)
    got = c.sql(sql)
    return (sorted(df.columns), rows(df.columns, df.collect())), (sorted(got.columns), rows(got.columns, got.fetchall()))
