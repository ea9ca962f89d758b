"""Named queries over the input tables and their DuckDB twins.

``register(name, sql)`` pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` with an
ANSI SQL text that DuckDB runs on the same parquet files. Output columns are aliased
identically on both sides; doubles are rounded and timestamps formatted so that the two
engines hash the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
HEADLINE: list[str] = []


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        if headline:
            HEADLINE.append(name)
        return fn

    return deco


def ts_text(c) -> Column:
    """Timestamp as 'yyyy-MM-dd HH:mm:ss' (DuckDB: strftime(x, '%Y-%m-%d %H:%M:%S'))."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


def day_text(c) -> Column:
    """Date as 'yyyy-MM-dd' (DuckDB: strftime(x, '%Y-%m-%d'))."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


def r(c, digits: int = 2) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
