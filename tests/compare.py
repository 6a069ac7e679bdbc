"""Rows of a query against DuckDB's, as the driver compares them: columns by name, rows in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, (bool, str)):
        return str(v)
    if hasattr(v, "__float__"):
        return f"{float(v) + 0.0:.6g}" if abs(float(v)) < 1e6 or isinstance(v, float) else str(int(v))
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)
