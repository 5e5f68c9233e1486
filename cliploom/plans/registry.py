"""Named queries over the driver's tables, with equal DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import campaign, library, stored_files, streams, transcripts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*campaign.QUERIES, *transcripts.QUERIES, *stored_files.QUERIES, *streams.QUERIES, *library.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return campaign.SQL | transcripts.SQL | stored_files.SQL | streams.SQL | library.SQL


def without_sql() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries whose results depend on what was learned from the data; tests hold them against brute force."""
    return {f.__name__: f for f in streams.WITHOUT_SQL}
