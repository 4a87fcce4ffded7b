"""A query's rows against its SQL in DuckDB, as multisets of rows with columns sorted by name."""

import glob
import math
import os

import duckdb


def value(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    return str(v).replace(" 00:00:00", "")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def check(spark, sf_dir, query, sql, con):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    expected = rows(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(expected)
    assert got == expected
