"""Run a registered query on Spark and its statement on DuckDB and compare their rows."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows(names, records):
    """Rows with columns in name order, as a sorted list."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def spark_rows(frame):
    return sorted(frame.columns), rows(frame.columns, frame.collect())


def duck_rows(db, sql):
    result = db.execute(sql)
    names = [c[0] for c in result.description]
    return sorted(names), rows(names, result.fetchall())
