"""Result writers: partitioned Parquet, managed and external tables, small exports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvgrid.sources.tables import replace_table, spread, write_new_months


def write_conformance(df: DataFrame, path: str, partitions: Sequence[str] = ("year", "month")) -> None:
    """Write all months in one job, replacing exactly the months present in ``df``.

    Rows are shuffled to their month first, with a spread within the month so that no
    single task writes a whole month. Running a month again gives the same table.
    """
    df = df.repartition(*[F.col(c) for c in partitions], *spread(df, partitions))
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partitions).parquet(path))


def create_result_table(df: DataFrame, name: str, partitions: Sequence[str] = (),
                        sort: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """Build or rebuild a Parquet table, optionally partitioned and sorted.

    See :func:`pvgrid.sources.tables.replace_table`: the old rows stay readable until the new ones are written.
    """
    return replace_table(df, name, partitions, sort, path)


def continue_conformance(source: DataFrame, path: str, build: Callable[[DataFrame], DataFrame],
                         again: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Build and write the months of ``source`` that the result below ``path`` lacks; returns them."""
    return write_new_months(source, path, build, write_conformance, again)


def register_result(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Register existing Parquet files as an external table, with their partitions."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING parquet LOCATION '{path}'")
    if spark.catalog.listColumns(name) and any(c.isPartition for c in spark.catalog.listColumns(name)):
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def with_flag(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Add or replace a column of rows; :func:`pvgrid.sources.tables.update_table` does so in a stored table."""
    return df.withColumn(column, value)


def export_csv(df: DataFrame, path: str) -> None:
    """Write a report as CSV files with a header; the folder is replaced."""
    df.write.mode("overwrite").option("header", True).csv(path)


def export_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
