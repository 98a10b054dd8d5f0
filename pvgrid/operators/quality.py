"""Data-quality reports on readings and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvgrid.functions.exact import exact_avg, micro
from pvgrid.functions.previous import with_previous
from pvgrid.functions.quantiles import group_quantile


def duplicate_readings(ts: DataFrame, keys: tuple[str, ...] = ("circuit_id", "t_stamp")) -> DataFrame:
    """Keys that occur more than once."""
    return ts.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat in every column, with the number of surplus copies."""
    return (df.groupBy(*df.columns).agg((F.count("*") - 1).alias("n_extra"))
            .where(F.col("n_extra") > 0))


def _steps(df: DataFrame, key: str, time: str) -> DataFrame:
    """Seconds since the previous reading of the key; copies of a reading are 0 apart.

    Equal time stamps are combined first, and a window holds one key and day only.
    """
    times = df.groupBy(key, time).agg(F.count("*").alias("copies"))
    times = with_previous(times, (key,), time, {"_before_time": time})
    step = F.unix_timestamp(time) - F.unix_timestamp("_before_time")
    return times.withColumn("step", step).drop("_before_time")


def sampling_interval(ts: DataFrame, key: str = "circuit_id", time: str = "t_stamp") -> DataFrame:
    """Shortest step in seconds per circuit, longest first."""
    step = F.when(F.col("copies") > 1, F.lit(0)).otherwise(F.col("step"))
    return (_steps(ts, key, time).groupBy(key).agg(F.min(step).alias("min_diff_seconds"))
            .orderBy(F.col("min_diff_seconds").desc_nulls_last(), key))


def step_quantile(df: DataFrame, key: str = "postcode", time: str = "time", p: float = 0.99) -> DataFrame:
    """Interpolated quantile of the step in seconds per key, for one row per key and time."""
    return _steps(df, key, time).groupBy(key).agg(F.percentile("step", F.lit(p)).alias("step_seconds"))


def voltage_outliers(ts: DataFrame, below: float | None = 0, above: float | None = None,
                     pv_only: bool = True) -> DataFrame:
    """Readings outside the given voltage per PV circuit (or per circuit), most first."""
    ts = ts.where("is_pv") if pv_only else ts
    v = F.col("voltage")
    cond = F.lit(False)
    if below is not None:
        cond = v < below
    if above is not None:
        cond = cond | (v > above)
    return (ts.where(cond).groupBy("circuit_id").agg(F.count("voltage").alias("n_outliers"))
            .orderBy(F.col("n_outliers").desc(), "circuit_id"))


def missing_voltage_frequency(site: DataFrame, key: str = "edp_site_id", column: str = "voltage_avg") -> DataFrame:
    """How many sites have how many missing voltages."""
    per_site = site.groupBy(key).agg(F.count_if(F.col(column).isNull()).alias("n_missing"))
    return per_site.groupBy("n_missing").agg(F.count("*").alias("n_sites"))


def coverage(df: DataFrame, key: str, time: str) -> DataFrame:
    """Rows, distinct times and first and last time per key.

    Counted per (key, time) first, so a key with many rows is spread over all tasks.
    """
    times = df.groupBy(key, time).agg(F.count(time).alias("n"))
    return times.groupBy(key).agg(
        F.sum("n").alias("n_rows"), F.count(time).alias("n_times"),
        F.min(time).alias("min_time"), F.max(time).alias("max_time"))


def power_extremes(ts: DataFrame, meta: DataFrame) -> DataFrame:
    """1 % quantile and minimum of the mean circuit power per site, in kW."""
    keys = meta.select("site_id", "circuit_id", "circuit_polarity").distinct()
    rows = ts.where(F.col("is_pv")).select("circuit_id", "t_stamp", "power").join(keys, "circuit_id")
    mean = F.try_divide(F.sum(micro(F.col("power") * F.col("circuit_polarity"))) / F.lit(1e9),
                        F.count(F.col("power")))
    site = rows.groupBy("site_id", "t_stamp").agg(mean.alias("P"))
    return site.groupBy("site_id").agg(group_quantile(F.col("P"), 0.01).alias("p01"), F.min("P").alias("P_min"))


def negative_power_sites(ts: DataFrame, meta: DataFrame, below: float = -1) -> DataFrame:
    """Number of sites whose power ever falls below the limit."""
    return power_extremes(ts, meta).where(F.col("P_min") < below).agg(F.count("*").alias("count_sites"))


def capacity_consistency(meta: DataFrame) -> DataFrame:
    """Sites with several circuits that all state the same whole capacity."""
    return (meta.groupBy("site_id").agg(F.count("circuit_id").alias("n"),
                                        exact_avg(F.col("ac_capacity_kw")).alias("mean"),
                                        F.min("ac_capacity_kw").alias("least"))
            .where((F.col("n") > 1) & (F.col("mean").cast("int") == F.col("least").cast("int")))
            .select("site_id"))


def many_circuit_sites(meta: DataFrame, more_than: int = 3) -> DataFrame:
    """Number of sites with more circuits than given."""
    counts = meta.groupBy("site_id").agg(F.count("circuit_id").alias("n"))
    return counts.where(F.col("n") > more_than).agg(F.count("*").alias("n_sites"))


def few_circuit_rows(meta: DataFrame, at_most: int = 3) -> DataFrame:
    """Metadata rows of the sites with at most that many circuits."""
    counts = meta.groupBy("site_id").agg(F.count("circuit_id").alias("n"))
    return meta.join(counts.where(F.col("n") <= at_most), "site_id", "left_semi")


def sites_without_net_meter(meta: DataFrame) -> DataFrame:
    """Sites with several circuit types but no net meter."""
    net = meta.where(F.col("circuit_type") == "ac_load_net").select("site_id").distinct()
    return (meta.join(net, "site_id", "left_anti").groupBy("site_id")
            .agg(F.countDistinct("circuit_type").alias("n_types"))
            .where(F.col("n_types") > 1).select("site_id"))


def rows_per_month(results: DataFrame, unit: int = 1000) -> DataFrame:
    """Whole thousands of result rows per month."""
    return results.groupBy("year", "month").agg(
        F.floor(F.count("site_id") / unit).alias("thousands"))


def circuits_by_postcode(meta: DataFrame) -> DataFrame:
    """Circuits per postcode, most first."""
    return (meta.groupBy("postcode").agg(F.count("*").alias("n"))
            .orderBy(F.col("n").desc(), F.col("postcode").asc_nulls_last()))


def sites_without_postcode(meta: DataFrame) -> DataFrame:
    return meta.where(F.col("postcode").isNull()).select("site_id").distinct()


def circuit_types(meta: DataFrame) -> DataFrame:
    return meta.select("circuit_type").distinct()
