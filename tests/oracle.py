"""Compare registered queries with their SQL in DuckDB on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def normal(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    """Columns by name, rows sorted, so that neither order counts."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(made, key=lambda row: [(v is not None, str(type(v)), v) for v in row])


def from_sql(con, sql: str):
    result = con.execute(sql)
    return normal([d[0] for d in result.description], result.fetchall())


def from_spark(df):
    return normal(df.columns, df.collect())
