"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import os

import duckdb
import numpy as np

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    return v


def same(spark, run, sql, sf=SF):
    df = run(spark, sf)
    names = sorted(df.columns)
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    out = con.execute(sql)
    columns = [c[0] for c in out.description]
    assert sorted(columns) == names
    a = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    b = sorted((tuple(norm(r[columns.index(c)]) for c in names) for r in out.fetchall()), key=repr)
    assert a == b
