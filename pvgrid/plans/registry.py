"""Registered queries: a Spark plan over the driver tables and, mostly, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvgrid.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_WIDENED = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}


def tidy(df: DataFrame) -> DataFrame:
    """Report integers as bigint and decimals as double."""
    casts = {name: _WIDENED.get(kind, "double" if kind.startswith("decimal") else kind)
             for name, kind in df.dtypes}
    return df.select(*[F.col(n).cast(k) if k != dict(df.dtypes)[n] else F.col(n)
                       for n, k in casts.items()])


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under ``name``; ``sql`` gives the same rows in DuckDB."""
    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(build(prepare(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return add
