"""Runs a query and its SQL side by side and reports the first difference."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def _plain(value):
    if isinstance(value, (bool, str)) or value is None:
        return value
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def difference(spark_df, con, sql: str) -> str | None:
    """None when names and rows agree, else a short description."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    want = _rows(names, result.fetchall())
    got = _rows(spark_df.columns, spark_df.collect())
    if got == want:
        return None if got else "no rows"
    extra = [r for r in got if r not in set(want)][:2]
    missing = [r for r in want if r not in set(got)][:2]
    return f"{len(got)} rows vs {len(want)}; {sorted(names)}; only spark {extra}; only sql {missing}"
