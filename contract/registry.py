"""Query registry: a Spark function and, where SQL can say it, the SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .fixtures import Tables, sql_with

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register ``fn(tables)`` under ``name``; ``ctes`` are the shared views the SQL starts from."""

    def deco(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql_with(sql, ctes)
        return fn

    return deco


def correct(expr: str, places: int) -> str:
    """SQL for rounding a DOUBLE's binary value correctly, as printf does."""
    return f"CAST(printf('%.{places}f', {expr}) AS DOUBLE)"


def rnd(expr: str, places: int) -> str:
    """SQL for half-up rounding of a DOUBLE's decimal text, which is how Spark's round works."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,18)), {places}) AS DOUBLE)"
