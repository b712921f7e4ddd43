"""Compares a query with its SQL, run by DuckDB over the same files."""

import math
import os

import duckdb


def connection(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            c.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return c


def value(x):
    if x is None or isinstance(x, (bool, str)):
        return x
    if isinstance(x, (int,)):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if hasattr(x, "isoformat"):
        return x.isoformat()[:19]
    if hasattr(x, "as_tuple"):
        return round(float(x), 6)
    return str(x)


def same_rows(df, sql, sf_dir):
    names = sorted(df.columns)
    ours = sorted((tuple(value(r[n]) for n in names) for r in df.collect()), key=repr)
    found = connection(sf_dir).execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    theirs = sorted((tuple(value(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert a == b
