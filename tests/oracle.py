"""Comparing a query's rows with DuckDB's for its SQL."""

import math
import os

import duckdb


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v)
    return str(v)


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = os.path.join(sf_dir, f)
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return sorted(found.columns), sorted(tuple(cell(r[i]) for i in order) for r in found.fetchall())


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(cell(r[c]) for c in names) for r in df.collect())
