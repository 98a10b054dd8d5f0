"""Registered queries: exposure, coverage and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvgrid.functions.exact import exact_sum, quantise
from pvgrid.operators import impact, quality, series
from pvgrid.operators.site import site_power, site_power_by_role
from pvgrid.plans import views
from pvgrid.plans.conformance_queries import (BANDS, BASE, DEVIATION, ROLE, SITE, VOLTVAR, VOLTVAR_ROWS,
                                              canonical_site, voltvar)
from pvgrid.plans.registry import register
from pvgrid.plans.sql_views import mic, q6, site, with_views, xavg, xsum
from pvgrid.session import stage

YM = "year(t_stamp) AS year, month(t_stamp) AS month"
PV = "P_pv > 0.16e0 * ac_capacity_kw"


def role_rows(spark, sf_dir):
    return site_power_by_role(views.ts(spark, sf_dir), views.meta(spark, sf_dir))


ZERO_SQL = (f"SELECT {YM}, site_id, COUNT(DISTINCT t_stamp) AS n_time FROM role "
            f"WHERE V > 253 AND P_net >= 0 AND {PV} GROUP BY ALL")
TOTAL_SQL = f"SELECT {YM}, site_id, COUNT(DISTINCT t_stamp) AS total_time FROM role GROUP BY ALL"
SOLAR_SQL = f"SELECT {YM}, site_id, COUNT(DISTINCT t_stamp) AS total_time_pv FROM role WHERE {PV} GROUP BY ALL"


@register("zero_export_high_voltage", with_views(ZERO_SQL, ROLE, views=BASE))
def _zero_export(spark, sf_dir):
    return impact.zero_export_high_voltage(role_rows(spark, sf_dir))


@register("observed_time", with_views(TOTAL_SQL, ROLE, views=BASE))
def _observed(spark, sf_dir):
    return impact.observed_time(role_rows(spark, sf_dir))


@register("solar_time", with_views(SOLAR_SQL, ROLE, views=BASE))
def _solar_time(spark, sf_dir):
    return impact.solar_time(role_rows(spark, sf_dir))


@register("high_voltage_sites", with_views(f"SELECT DISTINCT {YM}, site_id FROM role WHERE V > 253", ROLE, views=BASE))
def _high_voltage_sites(spark, sf_dir):
    return impact.high_voltage_sites(role_rows(spark, sf_dir))


def _share_sql(n: str, total: str, solar: str) -> str:
    return f"""
SELECT *, row_number() OVER (ORDER BY n_time_percentage_solar DESC, site_id) - 1 AS s_id
FROM (SELECT *, CAST(n_time AS DOUBLE) / total_time * 100 AS n_time_percentage,
             CAST(n_time AS DOUBLE) / total_time_pv * 100 AS n_time_percentage_solar
      FROM (SELECT site_id, CAST(SUM(n_time) AS BIGINT) AS n_time FROM ({n}) GROUP BY site_id)
      JOIN (SELECT site_id, CAST(SUM(total_time) AS BIGINT) AS total_time FROM ({total}) GROUP BY site_id) USING (site_id)
      JOIN (SELECT site_id, CAST(SUM(total_time_pv) AS BIGINT) AS total_time_pv FROM ({solar}) GROUP BY site_id)
        USING (site_id))"""


@register("exposure_share", with_views(_share_sql(ZERO_SQL, TOTAL_SQL, SOLAR_SQL), ROLE, views=BASE))
def _exposure(spark, sf_dir):
    return impact.zero_export_exposure(role_rows(spark, sf_dir))


HIGH_SQL = (f"SELECT {YM}, site_id, COUNT(DISTINCT t_stamp) AS n_time FROM "
            "(SELECT *, Q_adverse + Q_inactive + Q_minor_deviation + Q_major_deficit AS d FROM dev) "
            "WHERE V > 253 AND d = 0 AND Q_max < 0 GROUP BY ALL")


@register("conformant_but_high_voltage", with_views(HIGH_SQL, SITE, BANDS, DEVIATION, views=BASE))
def _conformant_high(spark, sf_dir):
    return impact.conformant_but_high_voltage(canonical_site(spark, sf_dir))


@register("conformant_exposure_share", with_views(
    _share_sql(HIGH_SQL, f"SELECT {YM}, site_id, COUNT(DISTINCT t_stamp) AS total_time FROM dev GROUP BY ALL", SOLAR_SQL),
    SITE, BANDS, DEVIATION, ROLE, views=BASE))
def _conformant_share(spark, sf_dir):
    site_rows = canonical_site(spark, sf_dir)
    return impact.exposure_share(impact.conformant_but_high_voltage(site_rows), impact.observed_time(site_rows),
                                 impact.solar_time(role_rows(spark, sf_dir)))


OPEN_SITE = ("site", site("true"))
COVER = ("cover", """
SELECT site_id, COUNT(*) FILTER (inside) AS num_data_vlim,
       quantile_disc(CASE WHEN inside THEN GHI END, 0.01) AS GHI_p1_vlim,
       quantile_disc(CASE WHEN inside THEN GHI END, 0.5) AS GHI_p50_vlim,
       quantile_disc(CASE WHEN inside THEN GHI END, 0.99) AS GHI_p99_vlim,
       COUNT(*) AS num_data_vall, quantile_disc(GHI, 0.01) AS GHI_p1_vall, quantile_disc(GHI, 0.5) AS GHI_p50_vall,
       quantile_disc(GHI, 0.99) AS GHI_p99_vall
FROM (SELECT s.site_id, s.t_stamp, V >= 220 AND V <= 240 AS inside, GHI
      FROM site s JOIN (SELECT DISTINCT site_id, n_lat, n_long FROM meta) m USING (site_id)
      JOIN held ON held.latitude = n_lat AND held.longitude = n_long AND held.t_stamp = s.t_stamp WHERE GHI > 0)
GROUP BY site_id HAVING COUNT(*) FILTER (inside) > 0""")
HELD_PF = ("held", """
SELECT latitude, longitude, GHI, unnest([time, time + INTERVAL 5 MINUTE]) AS t_stamp
FROM (SELECT DISTINCT time, latitude, longitude, GHI FROM solar
      JOIN (SELECT DISTINCT n_lat, n_long FROM meta WHERE pf_01 < 0.98e0) m ON latitude = n_lat AND longitude = n_long)""")


def _coverage(spark, sf_dir):
    meta = views.meta(spark, sf_dir)
    rows = site_power(views.ts(spark, sf_dir), meta, v_lo=None, v_hi=None, cell=True)
    return impact.deadband_irradiance_coverage(rows, meta, views.solar(spark, sf_dir))


@register("deadband_irradiance_coverage", with_views("SELECT * FROM cover", OPEN_SITE, HELD_PF, COVER,
                                                     views=(*BASE, "solar")))
def _deadband(spark, sf_dir):
    return _coverage(spark, sf_dir)


@register("poorly_covered_sites", with_views(
    "SELECT site_id FROM cover WHERE num_data_vlim < 60 AND num_data_vall > 150", OPEN_SITE, HELD_PF, COVER,
    views=(*BASE, "solar")))
def _poorly_covered(spark, sf_dir):
    return impact.poorly_covered_sites(_coverage(spark, sf_dir), few=60, many=150)


@register("site_pf_stats", with_views(f"""
SELECT site_id, {xavg('pf')} AS avg_pf, {q6('stddev_pop(pf)')} AS std_pf, quantile_disc(pf, 0.99) AS pf_99,
       quantile_disc(pf, 0.5) AS pf_50, quantile_disc(pf, 0.05) AS pf_05
FROM (SELECT site_id, {q6('P_kW / sqrt(P_kW * P_kW + Q_kvar * Q_kvar)')} AS pf FROM site
      WHERE P_kW > 0.2e0 * ac_capacity_kw AND (V > 240 OR V < 220)) GROUP BY site_id""", OPEN_SITE, views=BASE))
def _pf_stats(spark, sf_dir):
    rows = site_power(views.ts(spark, sf_dir), views.meta(spark, sf_dir), v_lo=None, v_hi=None)
    return impact.site_pf_stats(rows).withColumn("std_pf", quantise(F.col("std_pf")))


# --- data quality --------------------------------------------------------------

@register("duplicate_readings", with_views(
    "SELECT circuit_id, t_stamp, COUNT(*) AS n FROM ts GROUP BY ALL HAVING COUNT(*) > 1", views=("placed", "ts")))
def _duplicates(spark, sf_dir):
    return quality.duplicate_readings(views.ts(spark, sf_dir))


@register("duplicate_rows", with_views(
    "SELECT *, COUNT(*) - 1 AS n_extra FROM ts GROUP BY ALL HAVING COUNT(*) > 1", views=("placed", "ts")))
def _duplicate_rows(spark, sf_dir):
    return quality.duplicate_rows(views.ts(spark, sf_dir))


@register("sampling_interval", with_views("""
SELECT circuit_id, CAST(MIN(epoch(t_stamp) - epoch(p)) AS BIGINT) AS min_diff_seconds
FROM (SELECT circuit_id, t_stamp, lag(t_stamp) OVER (PARTITION BY circuit_id ORDER BY t_stamp) AS p FROM ts)
GROUP BY circuit_id""", views=("placed", "ts")))
def _sampling(spark, sf_dir):
    return quality.sampling_interval(views.ts(spark, sf_dir))


@register("event_sampling_interval", """
WITH e AS (SELECT user_id AS circuit_id, time_bucket(INTERVAL 5 MINUTE, ts) AS t_stamp FROM events)
SELECT circuit_id, CAST(MIN(epoch(t_stamp) - epoch(p)) AS BIGINT) AS min_diff_seconds
FROM (SELECT circuit_id, t_stamp, lag(t_stamp) OVER (PARTITION BY circuit_id ORDER BY t_stamp) AS p FROM e)
GROUP BY circuit_id""")
def _event_sampling(spark, sf_dir):
    step = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 300) * 300)
    rows = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("circuit_id"), step.alias("t_stamp"))
    return quality.sampling_interval(rows)


@register("postcode_step_quantile", with_views(f"""
SELECT postcode, {q6('quantile_cont(epoch(time) - epoch(p), 0.99)')} AS step_seconds
FROM (SELECT postcode, time, lag(time) OVER (PARTITION BY postcode ORDER BY time) AS p
      FROM (SELECT DISTINCT postcode, time FROM solar)) GROUP BY postcode""", views=("solar",)))
def _postcode_step(spark, sf_dir):
    steps = quality.step_quantile(views.solar(spark, sf_dir).select("postcode", "time").distinct())
    return steps.withColumn("step_seconds", quantise(F.col("step_seconds")))


@register("negative_voltages", with_views(
    "SELECT circuit_id, COUNT(voltage) AS n_outliers FROM ts WHERE is_pv AND voltage < 0 GROUP BY circuit_id", views=("placed", "ts")))
def _negative_voltages(spark, sf_dir):
    return quality.voltage_outliers(views.ts(spark, sf_dir))


@register("voltages_above_300", with_views(
    "SELECT circuit_id, COUNT(voltage) AS n_outliers FROM ts WHERE is_pv AND voltage > 300 GROUP BY circuit_id", views=("placed", "ts")))
def _high_voltages(spark, sf_dir):
    return quality.voltage_outliers(views.ts(spark, sf_dir), below=None, above=300)


COVERAGE_SQL = "COUNT(t) AS n_rows, COUNT(DISTINCT t) AS n_times, MIN(t) AS min_time, MAX(t) AS max_time"


@register("circuit_coverage", with_views(
    f"SELECT circuit_id, {COVERAGE_SQL} FROM (SELECT circuit_id, t_stamp AS t FROM ts) GROUP BY circuit_id",
    views=("placed", "ts")))
def _circuit_coverage(spark, sf_dir):
    return quality.coverage(views.ts(spark, sf_dir), "circuit_id", "t_stamp")


@register("postcode_coverage", with_views(
    f"SELECT postcode, {COVERAGE_SQL} FROM (SELECT postcode, time AS t FROM solar WHERE GHI IS NOT NULL) GROUP BY postcode",
    views=("solar",)))
def _postcode_coverage(spark, sf_dir):
    return quality.coverage(views.solar(spark, sf_dir).where("GHI IS NOT NULL"), "postcode", "time")


EXTREMES = ("ex", f"""
SELECT site_id, quantile_disc(P, 0.01) AS p01, MIN(P) AS P_min
FROM (SELECT site_id, t_stamp, CAST(SUM({mic('power * circuit_polarity')}) AS DOUBLE) / 1e9 / COUNT(power) AS P
      FROM ts JOIN (SELECT DISTINCT site_id, circuit_id, circuit_polarity FROM meta) m USING (circuit_id)
      WHERE is_pv GROUP BY ALL) GROUP BY site_id""")


@register("power_extremes", with_views("SELECT * FROM ex", EXTREMES, views=BASE))
def _extremes(spark, sf_dir):
    return quality.power_extremes(views.ts(spark, sf_dir), views.meta(spark, sf_dir))


@register("negative_power_sites", with_views("SELECT COUNT(*) AS count_sites FROM ex WHERE P_min < 0.5", EXTREMES, views=BASE))
def _negative_power(spark, sf_dir):
    return quality.negative_power_sites(views.ts(spark, sf_dir), views.meta(spark, sf_dir), below=0.5)


@register("negative_power_sites_at_default", with_views("SELECT COUNT(*) AS count_sites FROM ex WHERE P_min < -1", EXTREMES, views=BASE))
def _negative_power_default(spark, sf_dir):
    return quality.negative_power_sites(views.ts(spark, sf_dir), views.meta(spark, sf_dir))


@register("capacity_consistency", with_views("""
SELECT site_id FROM meta GROUP BY site_id HAVING COUNT(circuit_id) > 1
AND CAST(trunc(AVG(ac_capacity_kw)) AS INTEGER) = CAST(trunc(MIN(ac_capacity_kw)) AS INTEGER)""", views=("meta",)))
def _capacity(spark, sf_dir):
    return quality.capacity_consistency(views.meta(spark, sf_dir))


@register("many_circuit_sites", with_views(
    "SELECT COUNT(*) AS n_sites FROM (SELECT site_id FROM metered GROUP BY site_id HAVING COUNT(circuit_id) > 2)",
    views=("meta", "metered")))
def _many_circuits(spark, sf_dir):
    return quality.many_circuit_sites(views.metered_circuits(spark, sf_dir), 2)


@register("few_circuit_rows", with_views(
    "SELECT site_id, circuit_id, circuit_type FROM metered WHERE site_id IN "
    "(SELECT site_id FROM metered GROUP BY site_id HAVING COUNT(circuit_id) <= 2)", views=("meta", "metered")))
def _few_circuits(spark, sf_dir):
    return quality.few_circuit_rows(views.metered_circuits(spark, sf_dir), 2).select("site_id", "circuit_id", "circuit_type")


@register("sites_without_net_meter", with_views("""
SELECT site_id FROM meta WHERE site_id NOT IN (SELECT site_id FROM meta WHERE circuit_type = 'ac_load_net')
GROUP BY site_id HAVING COUNT(DISTINCT circuit_type) > 1""", views=("meta",)))
def _no_net_meter(spark, sf_dir):
    return quality.sites_without_net_meter(views.meta(spark, sf_dir))


@register("rows_per_month", with_views(
    "SELECT year, month, COUNT(site_id) // 10 AS thousands FROM conf GROUP BY year, month",
    SITE, BANDS, DEVIATION, VOLTVAR_ROWS, VOLTVAR, views=BASE))
def _rows_per_month(spark, sf_dir):
    return quality.rows_per_month(voltvar(spark, sf_dir), unit=10)


@register("rows_per_month_at_default", with_views(
    "SELECT year, month, COUNT(site_id) // 1000 AS thousands FROM conf GROUP BY year, month",
    SITE, BANDS, DEVIATION, VOLTVAR_ROWS, VOLTVAR, views=BASE))
def _rows_per_month_default(spark, sf_dir):
    return quality.rows_per_month(voltvar(spark, sf_dir))


@register("circuits_by_postcode", with_views("SELECT postcode, COUNT(*) AS n FROM meta GROUP BY postcode", views=("meta",)))
def _by_postcode(spark, sf_dir):
    return quality.circuits_by_postcode(views.meta(spark, sf_dir))


@register("sites_without_postcode", with_views("SELECT DISTINCT site_id FROM meta WHERE postcode IS NULL", views=("meta",)))
def _no_postcode(spark, sf_dir):
    return quality.sites_without_postcode(views.meta(spark, sf_dir))


@register("circuit_types", with_views("SELECT DISTINCT circuit_type FROM meta", views=("meta",)))
def _circuit_types(spark, sf_dir):
    return quality.circuit_types(views.meta(spark, sf_dir))


# --- series --------------------------------------------------------------------

@register("fleet_total_group", with_views(f"""
SELECT t_stamp, CAST(site_id AS VARCHAR) AS site_id, P_kW, V FROM site
UNION ALL SELECT t_stamp, 'All', {xsum('P_kW')}, MAX(V) FROM site GROUP BY t_stamp""", SITE, views=BASE))
def _total_group(spark, sf_dir):
    return series.add_total_group(stage(canonical_site(spark, sf_dir), "site-rows"), "t_stamp", "site_id",
                                  {"P_kW": exact_sum(F.col("P_kW")), "V": F.max("V")})


PERIODS = ("per", "SELECT *, CAST(floor((m + 86400 - epoch(t_stamp)) / 86400) AS BIGINT) AS num_periods "
                  "FROM site, (SELECT MAX(epoch(t_stamp)) AS m FROM site)")


@register("period_index", with_views("SELECT site_id, t_stamp, num_periods FROM per", SITE, PERIODS, views=BASE))
def _period_index(spark, sf_dir):
    return series.period_index(stage(canonical_site(spark, sf_dir), "site-rows"), "t_stamp", 86400).select(
        "site_id", "t_stamp", "num_periods")


@register("period_series", with_views("""
SELECT num_periods, site_id, string_agg(CAST(CAST(epoch(t_stamp) AS BIGINT) AS VARCHAR), ',' ORDER BY t_stamp) AS times,
       string_agg(CAST(CAST(round(P_kW * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY t_stamp) AS power
FROM per GROUP BY num_periods, site_id""", SITE, PERIODS, views=BASE))
def _period_series(spark, sf_dir):
    lists = series.period_series(stage(canonical_site(spark, sf_dir), "site-rows"), "t_stamp", "site_id", ("P_kW",))
    times = F.transform("t_stamp", lambda t: F.unix_timestamp(t).cast("string"))
    power = F.transform("P_kW", lambda p: F.round(p * 1e6).cast("bigint").cast("string"))
    return lists.select("num_periods", "site_id", F.concat_ws(",", times).alias("times"),
                        F.concat_ws(",", power).alias("power"))


@register("energy_to_power", with_views("""
SELECT site_id, t_stamp, Q_kvar * (3600 // step) / 1e3 AS Q_kvar, mixed AS mixed_steps, step AS step_seconds
FROM site JOIN (SELECT site_id, arg_max(step, n * 1e9 - step) AS step, COUNT(*) > 1 AS mixed
  FROM (SELECT site_id, step, COUNT(*) AS n FROM
    (SELECT site_id, CAST(epoch(t_stamp) - epoch(lag(t_stamp) OVER (PARTITION BY site_id ORDER BY t_stamp)) AS BIGINT) AS step
     FROM site) WHERE step IS NOT NULL GROUP BY ALL) GROUP BY site_id) USING (site_id)""", SITE, views=BASE))
def _energy_to_power(spark, sf_dir):
    site_rows = stage(canonical_site(spark, sf_dir), "site-rows")
    rows = series.energy_to_power(site_rows, "site_id", "t_stamp", ("Q_kvar",), to_mega=True)
    return rows.select("site_id", "t_stamp", "Q_kvar", "mixed_steps", "step_seconds")
