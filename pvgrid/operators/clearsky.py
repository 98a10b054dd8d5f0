"""Solar grid, clear-sky days and the structured table of actual and clear-sky rows.

A grid cell is (latitude, longitude). Cell values come straight from the grid, so the
joins compare equal doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvgrid.functions.curves import apparent_power, power_factor
from pvgrid.functions.exact import exact_avg
from pvgrid.functions.localtime import local_day, tod_bin
from pvgrid.functions.quantiles import frame_quantile
from pvgrid.operators.site import normalise
from pvgrid.session import stage

CELL = ["latitude", "longitude"]


def solar_by_postcode(grid: DataFrame, points: DataFrame, measures: tuple[str, ...],
                      required: str = "surface_global_irradiance", digits: int | None = 2) -> DataFrame:
    """Mean of the measures per time and postcode.

    Pixels are matched to postcode points on whole hundredths of a degree
    (``digits=None``: on the unrounded coordinates).
    """
    def key(name: str) -> Column:
        c = F.col(name)
        return c if digits is None else F.floor(c * 10**digits + 0.5)

    keyed = points.select(key("latitude").alias("_lat"), key("longitude").alias("_lon"), "postcode")
    rows = grid.where(F.col(required).isNotNull()).withColumns(
        {"_lat": key("latitude"), "_lon": key("longitude")}).select("_lat", "_lon", "time", *measures)
    return rows.join(keyed, ["_lat", "_lon"]).groupBy("time", "postcode").agg(
        *[exact_avg(F.col(m)).alias(m) for m in measures])


def grid_of_sites(solar: DataFrame, cells: DataFrame) -> DataFrame:
    """Distinct 10-minute grid rows of the cells that contain sites."""
    used = cells.select(*CELL).distinct()
    return solar.join(used, CELL, "left_semi").select("time", *CELL, "GHI", "cloud_type").distinct()


def site_cells(meta: DataFrame) -> DataFrame:
    """Distinct (site, cell) pairs of the metadata."""
    return meta.select("site_id", F.col("n_lat").alias("latitude"),
                       F.col("n_long").alias("longitude")).distinct()


def hold_to_5min(grid: DataFrame) -> DataFrame:
    """Each 10-minute row twice, the second time five minutes later."""
    held = F.explode(F.array(F.col("time"), F.timestamp_add("MINUTE", F.lit(5), F.col("time"))))
    return grid.withColumn("time_5min", held).drop("time")


def daily_cloud(grid: DataFrame) -> DataFrame:
    """Cloud sum and peak irradiance per cell and local day."""
    return grid.withColumn("day", local_day(F.col("time"))).groupBy(*CELL, "day").agg(
        F.sum("cloud_type").alias("cloud_sum"), F.max("GHI").alias("max_GHI"))


def clear_sky_days(grid: DataFrame, max_rank: int = 3, cloud_below: int = 60, min_peak: float = 200,
                   cloudless: bool = False) -> DataFrame:
    """The clearest days of each cell and month.

    Days rank by cloud sum, then by date. ``cloudless=True`` additionally asks for a
    cloud sum of exactly 0.
    """
    days = daily_cloud(grid)
    w = Window.partitionBy(*CELL, F.trunc("day", "month")).orderBy("cloud_sum", "day")
    ranked = days.withColumn("rn", F.row_number().over(w))
    clear = ranked.where((F.col("rn") <= max_rank) & (F.col("cloud_sum") < cloud_below)
                         & (F.col("max_GHI") > min_peak))
    return clear.where(F.col("cloud_sum") == 0) if cloudless else clear


def zero_cloud_days(grid: DataFrame) -> DataFrame:
    """Days of a cell without any cloud, whatever their rank or peak."""
    return daily_cloud(grid).where(F.col("cloud_sum") == 0).select(*CELL, "day")


def nearest_clear_sky_day(cell_days: DataFrame, clear_days: DataFrame) -> DataFrame:
    """For every (cell, day) the closest clear day of the cell, the later one on a tie.

    Days and clear days are merged into one calendar per cell and the last clear day
    before and the first after each day are carried along it, so no day is paired with
    every clear day.
    """
    calendar = (
        cell_days.select(*CELL, "day", F.lit(1).alias("actual"), F.lit(0).alias("clear"))
        .unionByName(clear_days.select(*CELL, "day", F.lit(0).alias("actual"), F.lit(1).alias("clear")))
        .groupBy(*CELL, "day").agg(F.max("actual").alias("actual"), F.max("clear").alias("clear")))
    clear_day = F.when(F.col("clear") == 1, F.col("day"))

    def carried(order: Column) -> Column:
        w = Window.partitionBy(*CELL).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return F.last(clear_day, ignorenulls=True).over(w)

    merged = calendar.withColumns({"before": carried(F.col("day").asc()),
                                   "after": carried(F.col("day").desc())})
    day, before, after = F.col("day"), F.col("before"), F.col("after")
    later = before.isNull() | (F.datediff(after, day) <= F.datediff(day, before))
    return (merged.where(F.col("actual") == 1)
            .select(*CELL, F.col("day").alias("actual_day"),
                    F.when(later & after.isNotNull(), after).otherwise(before).alias("cs_day"))
            .where(F.col("cs_day").isNotNull()))


def segment_gaps(rows: DataFrame, minutes: int = 30) -> DataFrame:
    """Number the stretches of a site's local day that are separated by longer gaps."""
    w = Window.partitionBy("site_id", "day").orderBy("t_stamp")
    gap = F.unix_timestamp("t_stamp") - F.unix_timestamp(F.lag("t_stamp").over(w))
    rows = rows.withColumn("day", local_day(F.col("t_stamp")))
    rows = rows.withColumn("gap_start", F.when(gap > minutes * 60, 1).otherwise(0))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("segment_id", F.sum("gap_start").over(running)).drop("gap_start")


def with_irradiance(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Site rows with the grid values of their cell and time; ``lit`` marks a match.

    ``held`` may carry further columns per (cell, time).
    """
    lit = held.withColumnRenamed("time_5min", "t_stamp").withColumn("lit", F.lit(True))
    return rows.join(lit, [*CELL, "t_stamp"], "left").withColumn("lit", F.col("lit").isNotNull())


def clear_sky_profile(rows: DataFrame, clear: DataFrame) -> DataFrame:
    """Smoothed clear-sky power and irradiance per site, clear day and time of day.

    ``rows`` come from :func:`with_irradiance` with P_kw_norm, ``clear`` lists the
    (cell, day) in use. Whole days are selected first, so segments keep their meaning
    while only clear days are windowed; both windows share one shuffle by site and day.
    """
    wanted = clear.select(*CELL, "day").distinct()
    rows = rows.withColumn("day", local_day(F.col("t_stamp"))).join(wanted, [*CELL, "day"], "left_semi")
    rows = segment_gaps(rows).where("lit")
    w = Window.partitionBy("site_id", "day", "segment_id").orderBy("t_stamp")
    return rows.select(
        "site_id", F.col("day").alias("cs_day"), tod_bin(F.col("t_stamp")).alias("cs_tod"),
        frame_quantile(F.col("P_kw_norm"), w).alias("P_kw_norm_cs"),
        frame_quantile(F.col("GHI"), w).alias("GHI_cs"),
        F.col("cloud_type").alias("cloud_type_cs"))


def held_with_clear_day(grid: DataFrame) -> DataFrame:
    """The 5-minute grid with the local day and the nearest clear day of each row's cell.

    The clear day is attached on the grid side, which is much smaller than the site
    rows; cells without any clear day drop out.
    """
    held = hold_to_5min(grid).withColumn("actual_day", local_day(F.col("time_5min")))
    cell_days = held.select(*CELL, F.col("actual_day").alias("day")).distinct()
    nearest = nearest_clear_sky_day(cell_days, clear_sky_days(grid))
    return held.join(nearest, [*CELL, "actual_day"])


def structured_data(site: DataFrame, grid: DataFrame, max_days: int = 45) -> DataFrame:
    """Actual rows next to the profile of the nearest clear day of their cell.

    ``site`` are site rows of the eligible sites with their cell, ``grid`` the rows of
    :func:`grid_of_sites`. They meet in one join by cell and time; the joined rows are staged, because both the clear-sky
    profile and the actual rows read them. The grid and what follows from it are staged before, so that their size is
    known when the much larger site rows meet them: these are shuffled only if the grid is too large for a broadcast.
    """
    grid = stage(grid, "grid")
    held = stage(held_with_clear_day(grid), "held")
    clear = stage(clear_sky_days(grid), "clear-days")
    columns = ("site_id", "t_stamp", *CELL, "V", "Q_kvar_norm", "P_kw_norm", "S_norm", "S_99")
    lit = with_irradiance(normalise(site).select(*columns), held)
    rows = stage(lit, "lit-rows")
    profile = clear_sky_profile(rows, clear)
    t = F.col("t_stamp")
    actual = rows.where(F.col("lit") & (F.abs(F.datediff("cs_day", "actual_day")) < max_days))
    actual = actual.withColumns({"actual_tod": tod_bin(t), "cs_tod": tod_bin(t)})
    return actual.join(profile, ["site_id", "cs_day", "cs_tod"]).select(
        "site_id", "t_stamp", "actual_day", "actual_tod", "V", "Q_kvar_norm", "P_kw_norm", "S_norm",
        "GHI", "cloud_type", "cs_day", "cs_tod", "P_kw_norm_cs", "GHI_cs", "cloud_type_cs", "S_99",
        F.year(t).alias("year"), F.month(t).alias("month"))


def detect_clear_sky_day(ghi: DataFrame, keys: tuple[str, ...] = ("day",), order: str = "time",
                         value: str = "ghi_mean", min_max_ghi: float = 500.0,
                         max_mean_step: float = 25.0) -> DataFrame:
    """Days whose irradiance changes slowly on average and peaks high enough."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.abs(F.col(value) - F.lag(value).over(w))
    days = ghi.withColumn("_step", step).groupBy(*keys).agg(
        exact_avg(F.col("_step")).alias("mean_step"), F.max(value).alias("max_ghi"))
    clear = (F.col("mean_step") < max_mean_step) & (F.col("max_ghi") >= min_max_ghi)
    return days.withColumn("is_clear_algo", F.coalesce(clear, F.lit(False)))


def clear_sky_agreement(labels: DataFrame, detected: DataFrame, on: str = "date") -> DataFrame:
    """Manual labels next to the detection, with a flag where they differ."""
    return labels.join(detected.select(on, "is_clear_algo"), on).select(
        on, "unsure", "is_clear", "is_clear_algo",
        (F.col("is_clear") != F.col("is_clear_algo")).alias("diff"))


def clear_period_counts(grid: DataFrame) -> DataFrame:
    """Number of cloudless time steps per postcode, most first."""
    steps = grid.groupBy("time", "postcode").agg(F.sum("cloud_type").alias("cloud_type"))
    return (steps.groupBy("postcode").agg(F.count_if(F.col("cloud_type") == 0).alias("num_clear_days"))
            .orderBy(F.col("num_clear_days").desc(), "postcode"))


def clear_day_peaks(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Highest GHI and power per site and cloudless day; rows need no GHI of their own."""
    held = hold_to_5min(grid).withColumnRenamed("time_5min", "t_stamp")
    rows = rows.withColumn("day", local_day(F.col("t_stamp")))
    clear = rows.join(zero_cloud_days(grid), [*CELL, "day"], "left_semi")
    return (clear.join(held, [*CELL, "t_stamp"], "left").groupBy("site_id", "day")
            .agg(F.max("GHI").alias("max_GHI"), F.max("P_kW").alias("max_P_kw")))


def clear_day_series(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows on clear days with S, PF, irradiance and smoothed power.

    ``rows`` are the site rows of the chosen sites with their cell, ``grid`` the grid of
    those sites.
    """
    clear = clear_sky_days(grid).select(*CELL, "day")
    rows = rows.withColumn("day", local_day(F.col("t_stamp"))).join(clear, [*CELL, "day"], "left_semi")
    rows = segment_gaps(with_irradiance(rows, hold_to_5min(grid))).where("lit")
    w = Window.partitionBy("site_id", "day", "segment_id").orderBy("t_stamp")
    p, q = F.col("P_kW"), F.col("Q_kvar")
    return rows.select(
        "site_id", "t_stamp", "P_kW", "Q_kvar", "V", apparent_power(p, q).alias("S_kva"),
        power_factor(p, q).alias("pf"), "GHI", "cloud_type", "ac_capacity_kw", "segment_id",
        frame_quantile(p, w).alias("P_est"))
