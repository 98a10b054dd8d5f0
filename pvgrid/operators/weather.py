"""Station temperatures and their attachment to sites."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def station_daily_max_temp(tables: list[DataFrame], stations: DataFrame, year: int = 2024,
                           hours: tuple[int, int] = (10, 14)) -> DataFrame:
    """Daily maximum of midday air temperature for the listed stations, of each table on its own.

    A station that several tables hold has a row from each of them. The year is a range
    of times, which the scan can use.
    """
    wanted = stations.select("station_number").distinct()
    t = F.col("datetime")

    def daily(table: DataFrame) -> DataFrame:
        rows = table.where((t >= F.lit(datetime(year, 1, 1))) & (t < F.lit(datetime(year + 1, 1, 1)))
                           & F.hour(t).between(*hours))
        return (rows.join(wanted, "station_number", "left_semi").groupBy("station_number", F.to_date(t).alias("day"))
                .agg(F.max("air_temperature_in_degrees_c").alias("temp")))

    return reduce(lambda a, b: a.unionByName(b), [daily(table) for table in tables])


def site_temperature_fallback(site_days: DataFrame, site_stations: DataFrame,
                              temperatures: DataFrame) -> DataFrame:
    """Site-days with the first temperature known among the site's three stations.

    Of several temperatures of a station and day the highest counts.
    """
    rows = site_days.join(site_stations, "site_id")
    temperatures = temperatures.groupBy("station_number", "day").agg(F.max("temp").alias("temp"))
    for i in (1, 2, 3):
        temp = temperatures.select(F.col("station_number").alias(f"station_{i}"), "day",
                                   F.col("temp").alias(f"temp_{i}"))
        rows = rows.join(temp, [f"station_{i}", "day"], "left")
    rows = rows.withColumn("temp", F.coalesce("temp_1", "temp_2", "temp_3"))
    return rows.select("day", "max_P_kw", "max_GHI", "temp", "site_id",
                       (F.col("max_GHI") * F.col("temp")).alias("GHI_T"))
