"""Comparison of a query with its DuckDB SQL: same columns, kinds and rows in any order."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def _cell(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def _rows(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_cell(r[k]) for k in order) for r in rows), key=repr)


def differences(df: DataFrame, sql: str, sf_dir: str) -> str:
    """Empty if both agree."""
    c = connect(sf_dir).execute(sql)
    theirs_columns = [x[0] for x in c.description]
    theirs = _rows(theirs_columns, c.fetchall())
    if sorted(df.columns) != sorted(theirs_columns):
        return f"columns {df.columns} and {theirs_columns}"
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    for a, b in zip(ours, theirs, strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} and {b}"
    return ""
