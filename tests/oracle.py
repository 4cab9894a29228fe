"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*'}')")
    return con


def plain(value) -> str:
    """A value in a form that both engines agree on."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, decimal.Decimal):
        return repr(round(float(value), 6))
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.sql(sql)
    columns = sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    return columns, sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
