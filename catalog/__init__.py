"""Registered queries and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def register(build):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def r6(value: Column | str, name: str | None = None) -> Column:
    """Rounded to six decimals without negative zero."""
    column = F.col(value) if isinstance(value, str) else value
    rounded = F.round(column, 6) + F.lit(0.0)
    if name is None and isinstance(value, str):
        name = value.rsplit(".", 1)[-1]
    return rounded.alias(name) if name else rounded


def s6(expression: str, name: str | None = None) -> str:
    """SQL twin of :func:`r6`."""
    return f"round({expression}, 6) + 0e0 AS {name or expression}"


def load_all() -> None:
    from catalog import (  # noqa: F401
        alignment,
        files,
        functions,
        runs,
        streams,
        tracks,
    )
