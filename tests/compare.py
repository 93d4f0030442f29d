"""Run queries against their SQL counterparts and report differences."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    return (1, value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    frame = frame[columns].astype(object)
    return sorted(tuple(_plain(v) for v in row) for row in frame.itertuples(index=False, name=None))


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(sql_frame.columns)}"
    left, right = rows(spark_frame), rows(sql_frame)
    if len(left) != len(right):
        return f"{len(left)} rows and {len(right)} rows"
    for mine, theirs in zip(left, right):
        if mine != theirs:
            return f"row {mine} and {theirs}"
    return None
