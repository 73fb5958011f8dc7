"""Name -> (query, checking SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

DECIMALS = 6


def rounded(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """Round floating-point results, so that engines can be compared by value."""
    return df.withColumns({f.name: F.round(f.name, decimals) for f in df.schema
                           if isinstance(f.dataType, T.DoubleType)})


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its check, where SQL can express it."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def steps(*named: tuple[str, str] | str) -> str:
    """SQL from named steps ``(name, select)`` and a final select."""
    *before, last = named
    ctes = ",\n".join(f"{name} AS ({body.strip()})" for name, body in before)
    return f"WITH {ctes}\n{last.strip()}" if ctes else last.strip()
