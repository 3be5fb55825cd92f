"""Rows of a DataFrame and of DuckDB's SQL over the same tables, in one form."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return None if math.isnan(x) else round(float(x), 5)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x.isoformat() if isinstance(x, datetime.date) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def duck_rows(con, sql):
    found = con.sql(sql)
    return sorted(found.columns), rows_of(found.columns, found.fetchall())
