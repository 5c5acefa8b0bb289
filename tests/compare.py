"""Run queries next to their SQL counterparts."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if (Path(sf_dir) / f"{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    """A value in a form both engines share."""
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fixed = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(fixed, key=repr)


def both(spark, connection, query, sql: str, sf_dir: str):
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    result = connection.execute(sql)
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    return ours, theirs
