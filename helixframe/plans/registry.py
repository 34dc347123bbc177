"""Registry of named queries and their SQL oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables
(``{sf_dir}/{name}.parquet``); its oracle is an ANSI SQL string that DuckDB
runs over views of the same tables.  Column names are aliased identically on
both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn`` under ``key`` (lower-case operator id) with its oracle."""
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One driver table; naming the columns lets the scan read only those."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df
