"""Site, circuit and address metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CIRCUIT_SCHEMA = ("site_id bigint, device_id bigint, device_type string, circuit_id bigint, "
                  "circuit_polarity int, circuit_type string")
SITE_SCHEMA = ("site_id bigint, state string, postcode int, latitude double, longitude double, "
               "dnsp_name string, dc_capacity_kw double, ac_capacity_kw double, "
               "export_limit_kw double, monitoring_start timestamp, inverter_info string")


def site_meta(sites: DataFrame, circuits: DataFrame) -> DataFrame:
    """One row per circuit with the columns of its site; circuits without a site stay."""
    return circuits.join(sites, "site_id", "left")


def without_null_columns(df: DataFrame) -> DataFrame:
    """Drop every column that holds a null; all columns are checked in one pass."""
    flags = df.agg(*[F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias(c)
                     for c in df.columns]).first()
    return df.select(*[c for c in df.columns if not flags[c]])


def read_address_points(spark: SparkSession, points_path: str, details_path: str) -> DataFrame:
    """Latitude, longitude and postcode of street localities from two piped text files."""
    def read(path: str) -> DataFrame:
        return without_null_columns(
            spark.read.option("sep", "|").option("header", True).csv(path))

    points = read(points_path).select("STREET_LOCALITY_PID", "LONGITUDE", "LATITUDE")
    details = read(details_path).select("STREET_LOCALITY_PID", "POSTCODE").distinct()
    joined = points.join(details, "STREET_LOCALITY_PID", "left").drop("STREET_LOCALITY_PID")
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in joined.columns])
    return joined.where(present).select(
        F.col("LATITUDE").cast("double").alias("latitude"),
        F.col("LONGITUDE").cast("double").alias("longitude"),
        F.col("POSTCODE").cast("int").alias("postcode"))
