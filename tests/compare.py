"""Rows of a Spark query against those of its SQL in DuckDB."""

import datetime
import math
import os

import duckdb


def _norm(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, int):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(_norm(r[c]) for c in columns) for r in df.collect())


def sql_rows(con, sql):
    result = con.sql(sql)
    names = list(result.columns)
    columns = sorted(names)
    return columns, sorted(tuple(_norm(r[names.index(c)]) for c in columns) for r in result.fetchall())


def assert_same(df, con, sql):
    columns, rows = spark_rows(df)
    other, expected = sql_rows(con, sql)
    assert columns == other
    assert len(rows) == len(expected)
    assert rows == expected
