"""Telemetry scan with partition filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TELEMETRY_SCHEMA = (
    "device_id bigint, circuit_id bigint, t_stamp timestamp, power double, energy double, "
    "energy_reactive double, energy_import double, energy_export double, "
    "energy_reactive_import double, energy_reactive_export double, power_factor double, "
    "voltage double, current double"
)
PARTITION_SCHEMA = "year int, month int, is_pv boolean"


def _as_list(value) -> list:
    return list(value) if isinstance(value, Iterable) and not isinstance(value, str) else [value]


def read_metrology(spark: SparkSession, path: str, year=None, month=None,
                   is_pv: bool | None = None, recursive: bool = False) -> DataFrame:
    """Typed scan of partitioned telemetry; filters prune partitions before any file opens.

    ``year`` and ``month`` take one value or several. ``recursive=True`` reads every
    file below ``path`` and has no partition columns, so it takes no filters.
    """
    if recursive:
        if not (year is None and month is None and is_pv is None):
            raise ValueError("a recursive scan has no partition columns to filter on")
        return (spark.read.schema(TELEMETRY_SCHEMA)
                .option("recursiveFileLookup", "true").parquet(path))
    df = spark.read.schema(f"{TELEMETRY_SCHEMA}, {PARTITION_SCHEMA}").parquet(path)
    if year is not None:
        df = df.where(F.col("year").isin(_as_list(year)))
    if month is not None:
        df = df.where(F.col("month").isin(_as_list(month)))
    if is_pv is not None:
        df = df.where(F.col("is_pv") == F.lit(is_pv))
    return df
