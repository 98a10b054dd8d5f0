"""Exposure, fairness and data coverage of the voltage rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvgrid.functions.curves import power_factor
from pvgrid.functions.exact import exact_avg, quantise
from pvgrid.functions.localtime import calendar
from pvgrid.functions.ordinal import global_ordinal
from pvgrid.functions.quantiles import group_quantiles
from pvgrid.functions.slots import distinct_times
from pvgrid.operators.clearsky import hold_to_5min
from pvgrid.operators.conformance import voltvar_deviation

SOLAR_SHARE = 0.16


def _monthly(role: DataFrame) -> DataFrame:
    cal = calendar(F.col("t_stamp"))
    return role.withColumns({"year": cal["year"], "month": cal["month"]})


def _is_solar():
    return F.col("P_pv") > F.lit(SOLAR_SHARE) * F.col("ac_capacity_kw")


def _is_zero_export():
    return (F.col("V") > 253) & (F.col("P_net") >= 0) & _is_solar()


def zero_export_high_voltage(role: DataFrame) -> DataFrame:
    """Time stamps per site and month with high voltage although nothing is exported."""
    return (_monthly(role).where(_is_zero_export()).groupBy("year", "month", "site_id")
            .agg(distinct_times(F.col("t_stamp")).alias("n_time")))


def observed_time(role: DataFrame) -> DataFrame:
    """All observed time stamps per site and month."""
    return (_monthly(role).groupBy("year", "month", "site_id")
            .agg(distinct_times(F.col("t_stamp")).alias("total_time")))


def solar_time(role: DataFrame) -> DataFrame:
    """Time stamps per site and month with substantial PV output."""
    return (_monthly(role).where(_is_solar()).groupBy("year", "month", "site_id")
            .agg(distinct_times(F.col("t_stamp")).alias("total_time_pv")))


def high_voltage_sites(role: DataFrame) -> DataFrame:
    """Sites per month that ever exceed 253 V."""
    return _monthly(role).where(F.col("V") > 253).select("year", "month", "site_id").distinct()


def exposure_share(n_time: DataFrame, total: DataFrame, solar: DataFrame) -> DataFrame:
    """Share of observed and of solar time affected per site, highest first.

    Sites missing from one of the three reports are left out; ``s_id`` numbers the
    sites from 0 in the order of the solar share.
    """
    parts = [df.groupBy("site_id").agg(F.sum(c).alias(c))
             for df, c in ((n_time, "n_time"), (total, "total_time"), (solar, "total_time_pv"))]
    joined = parts[0].join(parts[1], "site_id").join(parts[2], "site_id")
    n = F.col("n_time").cast("double")
    joined = joined.withColumns({
        "n_time_percentage": n / F.col("total_time") * 100,
        "n_time_percentage_solar": n / F.col("total_time_pv") * 100})
    return global_ordinal(joined, F.col("n_time_percentage_solar").desc(), F.col("site_id"), name="s_id")


def zero_export_exposure(role: DataFrame) -> DataFrame:
    """:func:`exposure_share` of zero export, all three reports from one aggregation."""
    t = F.col("t_stamp")
    months = _monthly(role).groupBy("year", "month", "site_id").agg(
        distinct_times(t, _is_zero_export()).alias("n_time"), distinct_times(t).alias("total_time"),
        distinct_times(t, _is_solar()).alias("total_time_pv"))
    counts = months.groupBy("site_id").agg(*[F.sum(c).alias(c) for c in ("n_time", "total_time", "total_time_pv")])
    counts = counts.where((F.col("n_time") > 0) & (F.col("total_time_pv") > 0))
    n = F.col("n_time").cast("double")
    counts = counts.withColumns({
        "n_time_percentage": n / F.col("total_time") * 100,
        "n_time_percentage_solar": n / F.col("total_time_pv") * 100})
    return global_ordinal(counts, F.col("n_time_percentage_solar").desc(), F.col("site_id"), name="s_id")


def conformant_but_high_voltage(site: DataFrame, surplus_is_nonconformant: bool = False) -> DataFrame:
    """Rows above 253 V although the inverter absorbs as required, per site and month.

    By default surplus rows count as conformant here, unlike in the conformance report.
    """
    rows = voltvar_deviation(site.where(F.col("V") > 253), surplus_is_nonconformant=surplus_is_nonconformant)
    # The condition is counted, not filtered on: a filter would be pushed below the band
    # columns and repeat their whole definition at every reference.
    hit = (F.col("deviation") == 0) & (F.col("Q_max") < 0)
    rows = _monthly(rows).select("year", "month", "site_id", F.when(hit, F.col("t_stamp")).alias("hit_time"))
    return (rows.groupBy("year", "month", "site_id").agg(distinct_times(F.col("hit_time")).alias("n_time"))
            .where(F.col("n_time") > 0))


def deadband_irradiance_coverage(site: DataFrame, meta: DataFrame, solar: DataFrame,
                                 v_lo: float = 220, v_hi: float = 240, pf_below: float = 0.98) -> DataFrame:
    """Sunlit time stamps per site inside the dead band and overall, with GHI quantiles.

    ``site`` holds site rows with their cell and without voltage bounds. Only grid cells with a site whose
    low power factor shows a reactive response are used. Both counts come from one pass.
    """
    cell = ["latitude", "longitude"]
    responsive = (meta.where(F.col("pf_01") < pf_below)
                  .select(F.col("n_lat").alias("latitude"), F.col("n_long").alias("longitude")).distinct())
    grid = (solar.join(responsive, cell, "left_semi")
            .select("time", *cell, "GHI").distinct())
    held = hold_to_5min(grid).withColumnRenamed("time_5min", "t_stamp")
    rows = site.join(held, [*cell, "t_stamp"]).where(F.col("GHI") > 0)
    ghi, inside = F.col("GHI"), F.col("V").between(v_lo, v_hi)
    quantiles = {"p1": 0.01, "p50": 0.5, "p99": 0.99}
    out = rows.groupBy("site_id").agg(
        F.count_if(inside).alias("num_data_vlim"), group_quantiles(F.when(inside, ghi), quantiles.values()).alias("_vlim"),
        F.count("*").alias("num_data_vall"), group_quantiles(ghi, quantiles.values()).alias("_vall"))
    return out.where(F.col("num_data_vlim") > 0).select(
        "site_id", "num_data_vlim", *[F.get("_vlim", F.lit(k)).alias(f"GHI_{n}_vlim") for k, n in enumerate(quantiles)],
        "num_data_vall", *[F.get("_vall", F.lit(k)).alias(f"GHI_{n}_vall") for k, n in enumerate(quantiles)])


def poorly_covered_sites(coverage: DataFrame, few: int = 10, many: int = 500) -> DataFrame:
    """Sites with hardly any dead-band rows although they are well observed."""
    return coverage.where((F.col("num_data_vlim") < few) & (F.col("num_data_vall") > many)).select("site_id")


def site_pf_stats(site: DataFrame) -> DataFrame:
    """Power-factor statistics per site where a reactive response is due."""
    p, q, v = F.col("P_kW"), F.col("Q_kvar"), F.col("V")
    rows = site.where((p > F.lit(0.2) * F.col("ac_capacity_kw")) & ((v > 240) | (v < 220)))
    rows = rows.withColumn("pf", quantise(power_factor(p, q)))
    pf = F.col("pf")
    return rows.groupBy("site_id").agg(
        exact_avg(pf).alias("avg_pf"), F.stddev_pop(pf).alias("std_pf"),
        group_quantiles(pf, (0.99, 0.5, 0.05)).alias("_pf")).select(
        "site_id", "avg_pf", "std_pf", *[F.get("_pf", F.lit(k)).alias(n) for k, n in enumerate(("pf_99", "pf_50", "pf_05"))])
