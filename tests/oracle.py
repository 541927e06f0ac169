"""Spark results against DuckDB's, as the driver compares them."""

import decimal
import glob
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v


def rows_of(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def agree(df, sql, sf_dir):
    result = connection(sf_dir).execute(sql)
    want = rows_of([c[0] for c in result.description], result.fetchall())
    assert rows_of(df.columns, df.collect()) == want
