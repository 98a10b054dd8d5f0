"""Registered queries: spatial enrichment and the second data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvgrid.functions.exact import quantise
from pvgrid.operators import clearsky, edp, quality, spatial
from pvgrid.plans import views
from pvgrid.plans.registry import register
from pvgrid.plans.sql_views import mic, q6, with_views, xavg, xsum
from pvgrid.session import stage

D2 = "(l.longitude - s.longitude) * (l.longitude - s.longitude) + (l.latitude - s.latitude) * (l.latitude - s.latitude)"
RANKED = ("ranked", f"""SELECT *, {q6('sqrt(d2) * 111')} AS distance_km, row_number() OVER (PARTITION BY point_id ORDER BY d2, station_number) AS rank
FROM (SELECT point_id, l.latitude, l.longitude, station_number, {D2} AS d2 FROM locations l, stations s)""")
NEAREST_COLS = "point_id, latitude, longitude, station_number, distance_km"


def _km(df: DataFrame) -> DataFrame:
    return df.withColumn("distance_km", quantise(F.col("distance_km")))


@register("nearest_point", with_views(f"SELECT {NEAREST_COLS} FROM ranked WHERE rank = 1", RANKED, views=("locations", "stations")))
def _nearest(spark, sf_dir):
    return _km(spatial.nearest_point(views.locations(spark, sf_dir), views.stations(spark, sf_dir),
                                     "point_id", "station_number"))


@register("nearest_point_within", with_views(f"SELECT {NEAREST_COLS} FROM ranked WHERE rank = 1 AND distance_km <= 50", RANKED,
                                             views=("locations", "stations")))
def _nearest_within(spark, sf_dir):
    return _km(spatial.nearest_point(views.locations(spark, sf_dir), views.stations(spark, sf_dir),
                                     "point_id", "station_number", max_km=50))


@register("nearest_three_points", with_views(f"SELECT {NEAREST_COLS}, rank FROM ranked WHERE rank <= 3", RANKED,
                                             views=("locations", "stations")))
def _nearest_three(spark, sf_dir):
    return _km(spatial.nearest_point(views.locations(spark, sf_dir), views.stations(spark, sf_dir),
                                     "point_id", "station_number", k=3))


@register("points_in_polygons", with_views("""
SELECT point_id, latitude, longitude, region_id FROM locations, (
  SELECT n_nationkey AS n, 115e0 + CAST(n_nationkey * 7 % 25 AS DOUBLE) + 0.25e0 AS x0,
         -40e0 + CAST(n_nationkey % 25 AS DOUBLE) + 0.25e0 AS y0, unnest([0, 1, 2]) AS shape, n_nationkey * 3 + shape AS region_id
  FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation))
WHERE CASE WHEN shape = 0 THEN longitude > x0 AND longitude < x0 + 2 AND latitude > y0 AND latitude < y0 + 1
           WHEN shape = 1 THEN longitude > x0 + 4 AND latitude > y0 AND (longitude - x0 - 4) + (latitude - y0) < 2
           ELSE longitude > x0 + 8 AND longitude < x0 + 11 AND latitude > y0 AND latitude < y0 + 3
                AND NOT (longitude BETWEEN x0 + 9 AND x0 + 10 AND latitude BETWEEN y0 + 1 AND y0 + 2)
                OR longitude > x0 + 12 AND longitude < x0 + 13 AND latitude > y0 AND latitude < y0 + 1 END""",
    views=("locations",)))
def _in_polygons(spark, sf_dir):
    return spatial.points_in_polygons(views.locations(spark, sf_dir), views.regions(spark, sf_dir), "region_id")


# --- second data set -----------------------------------------------------------

EDP_VIEWS = ("placed", "ts", "edp_readings", "edp_sites", "edp_postcodes")
RATING = ("rating", f"""SELECT edp_site_id, postcode, {xsum('inverter_ac_rating_kw * coalesce(inverter_count, 1)')} AS Srated
FROM edp_sites JOIN edp_postcodes USING (edp_site_id) WHERE state = 'SA' GROUP BY ALL""")
V = "voltage_avg"
EDP = ("edp", f"""
SELECT *, MAX(active_power > Srated) OVER (PARTITION BY edp_site_id) AS wrong_on_maxP,
  abs(abs(reactive_power - Q_voltvar) - Srated * 0.05e0) AS Q_noncomp, Q_voltvar + Srated * 0.05e0 AS Q_voltvar_max,
  Q_voltvar - Srated * 0.05e0 AS Q_voltvar_min,
  CASE WHEN P_threshold IS NOT NULL THEN greatest(active_power - P_threshold, 0e0) END AS P_noncomp
FROM (SELECT *, sqrt(active_power * active_power + reactive_power * reactive_power) AS apparent_power,
  CASE WHEN {V} IS NULL THEN NULL WHEN {V} < 253 THEN Srated WHEN {V} > 260 THEN 0.2e0 * Srated
       ELSE (Srated - 0.2e0 * Srated) / -7e0 * ({V} - 260e0) + 0.2e0 * Srated END AS P_threshold,
  CASE WHEN {V} IS NULL THEN NULL WHEN {V} < 207 THEN 0.44e0 * Srated WHEN {V} < 220 THEN 0.44e0 * Srated / -13e0 * ({V} - 220e0)
       WHEN {V} <= 240 THEN 0e0 WHEN {V} < 258 THEN 0.6e0 * Srated / -18e0 * ({V} - 258e0) - 0.6e0 * Srated
       ELSE -(0.6e0 * Srated) END AS Q_voltvar
FROM (SELECT datetime - INTERVAL 570 MINUTE AS time, edp_site_id, postcode, Srated,
  CAST(SUM({mic('real_energy')}) * 12 AS DOUBLE) / 1e9 AS active_power,
  CAST(SUM({mic('reactive_energy')}) * 12 AS DOUBLE) / 1e9 AS reactive_power,
  {xsum('current_avg')} AS current_avg, {xavg(f'CASE WHEN {V} <= 300 THEN {V} END')} AS voltage_avg
FROM edp_readings JOIN rating USING (edp_site_id) WHERE circuit_label = 'pv_site_net' GROUP BY ALL))""")


def rating(spark, sf_dir) -> DataFrame:
    return edp.edp_site_rating(views.edp_sites(spark, sf_dir), views.edp_postcodes(spark, sf_dir))


def processed(spark, sf_dir) -> DataFrame:
    return edp.process_edp(views.edp_readings(spark, sf_dir), rating(spark, sf_dir))


def _edp_sql(final: str) -> str:
    return with_views(final, RATING, EDP, views=EDP_VIEWS)


@register("edp_site_rating", with_views("SELECT * FROM rating", RATING, views=("edp_sites", "edp_postcodes")))
def _rating(spark, sf_dir):
    return rating(spark, sf_dir)


@register("process_edp", _edp_sql("SELECT * FROM edp"))
def _processed(spark, sf_dir):
    return processed(spark, sf_dir)


@register("edp_reactive_ranking", _edp_sql(
    f"SELECT edp_site_id, {xsum('Q_noncomp')} / 12 AS Q_noncomp, bool_or(wrong_on_maxP) AS wrong_on_maxP FROM edp "
    f"GROUP BY edp_site_id HAVING {xsum('Q_noncomp')} / 12 > 0"))
def _reactive(spark, sf_dir):
    return edp.reactive_ranking(processed(spark, sf_dir))


@register("edp_active_ranking", _edp_sql(
    f"SELECT edp_site_id, {xsum('P_noncomp')} AS P_noncomp, bool_or(wrong_on_maxP) AS wrong_on_maxP FROM edp GROUP BY edp_site_id"))
def _active(spark, sf_dir):
    return edp.active_ranking(processed(spark, sf_dir))


@register("edp_active_ranking_above_253", _edp_sql(
    f"SELECT edp_site_id, {xsum('P_noncomp')} AS P_noncomp, bool_or(wrong_on_maxP) AS wrong_on_maxP FROM edp "
    "WHERE voltage_avg > 253 GROUP BY edp_site_id"))
def _active_high(spark, sf_dir):
    return edp.active_ranking(processed(spark, sf_dir), 253)


DROPS = """SELECT time, edp_site_id, active_power, voltage_avg, DP, DP_r FROM (
  SELECT *, CASE WHEN DP IS NOT NULL THEN round_even(least(DP, 0e0), 0) END AS DP_r FROM (
    SELECT *, active_power - lag(active_power) OVER (PARTITION BY edp_site_id ORDER BY time) AS DP FROM edp))"""


LOW = ("low", "SELECT * REPLACE (CASE WHEN CAST(epoch(time) / 300 AS BIGINT) % 7 = 0 THEN 0.02e0 ELSE active_power END "
              "AS active_power) FROM edp")


def _trip_sql(where: str) -> str:
    return with_views(DROPS.replace("FROM edp", "FROM low") + f" WHERE {where}", RATING, EDP, LOW, views=EDP_VIEWS)


TRIP_COLS = ("time", "edp_site_id", "active_power", "voltage_avg", "DP", "DP_r")


@register("trip_events", _trip_sql("DP_r <= -1 AND active_power < 0.05 AND active_power >= -0.05 AND voltage_avg >= 258"))
def _trips(spark, sf_dir):
    return edp.trip_events(views.quiet_spells(processed(spark, sf_dir))).select(*TRIP_COLS)


@register("trip_events_loose", _trip_sql("DP_r < -1 AND active_power < 0.1 AND active_power >= -0.05 AND voltage_avg > 250"))
def _trips_loose(spark, sf_dir):
    return edp.trip_events(views.quiet_spells(processed(spark, sf_dir)), loose=True).select(*TRIP_COLS)


GAPPY = ("gappy", """SELECT time, edp_site_id, postcode,
  CASE WHEN CAST(epoch(time) / 300 AS BIGINT) % 5 < 2 THEN NULL ELSE active_power END AS active_power, voltage_avg FROM edp""")
FILL = """CASE WHEN {c} IS NOT NULL OR lag({c}) OVER w IS NULL THEN {c}
     WHEN nt{c} IS NULL THEN lag({c}) OVER w
     ELSE coalesce(lag({c}) OVER w + (nv{c} - lag({c}) OVER w) * (epoch(time) - epoch(lag(time) OVER w))
          / nullif(epoch(nt{c}) - epoch(lag(time) OVER w), 0), lag({c}) OVER w) END"""


@register("interpolate_time", with_views(f"""
SELECT time, edp_site_id, postcode, {q6(FILL.format(c='active_power'))} AS active_power, {q6(FILL.format(c='voltage_avg'))} AS voltage_avg
FROM (SELECT *, {', '.join(f'''first_value(CASE WHEN {c} IS NOT NULL THEN time END IGNORE NULLS) OVER f AS nt{c},
  first_value({c} IGNORE NULLS) OVER f AS nv{c}''' for c in ('active_power', 'voltage_avg'))} FROM gappy
  WINDOW f AS (PARTITION BY postcode, edp_site_id ORDER BY time ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
WINDOW w AS (PARTITION BY postcode, edp_site_id ORDER BY time)""", RATING, EDP, GAPPY, views=EDP_VIEWS))
def _interpolated(spark, sf_dir):
    rows = views.power_gaps(processed(spark, sf_dir))
    filled = edp.interpolate_time(rows, ("postcode", "edp_site_id"), "time",
                                  ("active_power", "voltage_avg"))
    return filled.withColumns({c: quantise(F.col(c)) for c in ("active_power", "voltage_avg")})


LIT = ("gappy", f"""SELECT e.time, edp_site_id, e.postcode, active_power, voltage_avg, GHI FROM edp e
LEFT JOIN (SELECT time, 5000 + CAST(floor(120 - longitude) AS BIGINT) % 25 AS postcode, {xavg('GHI')} AS GHI
           FROM solar WHERE GHI IS NOT NULL GROUP BY ALL) g ON g.time = e.time AND g.postcode = e.postcode""")
LIT_COLUMNS = ("GHI", "voltage_avg")


def postcode_irradiance(spark, sf_dir) -> DataFrame:
    """Mean irradiance per time and postcode of the second data set, by the cell's longitude."""
    postcode = F.lit(5000) + F.floor(F.lit(120) - F.col("longitude")) % 25
    points = views.solar(spark, sf_dir).select("latitude", "longitude", postcode.alias("postcode")).distinct()
    solar = views.solar(spark, sf_dir).drop("postcode")
    return clearsky.solar_by_postcode(solar, points, ("GHI",), required="GHI", digits=None)


@register("edp_with_irradiance", with_views(f"""
SELECT time, edp_site_id, postcode, active_power, {', '.join(f'{q6(FILL.format(c=c))} AS {c}' for c in LIT_COLUMNS)}
FROM (SELECT *, {', '.join(f'''first_value(CASE WHEN {c} IS NOT NULL THEN time END IGNORE NULLS) OVER f AS nt{c},
  first_value({c} IGNORE NULLS) OVER f AS nv{c}''' for c in LIT_COLUMNS)} FROM gappy
  WINDOW f AS (PARTITION BY postcode, edp_site_id ORDER BY time ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
WINDOW w AS (PARTITION BY postcode, edp_site_id ORDER BY time)""", RATING, EDP, LIT, views=(*EDP_VIEWS, "solar")))
def _edp_irradiance(spark, sf_dir):
    rows = stage(processed(spark, sf_dir).select("time", "edp_site_id", "postcode", "active_power", "voltage_avg"), "edp-rows")
    filled = edp.fill_with_irradiance(rows, postcode_irradiance(spark, sf_dir), LIT_COLUMNS)
    return filled.select("time", "edp_site_id", "postcode", "active_power", *[quantise(F.col(c)).alias(c) for c in LIT_COLUMNS])


@register("edp_reactive_ranking_missing_voltage", _edp_sql(
    f"SELECT edp_site_id, {xsum('Q_noncomp')} / 12 AS Q_noncomp, bool_or(wrong_on_maxP) AS wrong_on_maxP "
    f"FROM (SELECT * REPLACE (coalesce(Q_noncomp, abs(abs(reactive_power + 0.6e0 * Srated) - Srated * 0.05e0)) AS Q_noncomp) FROM edp) "
    f"GROUP BY edp_site_id HAVING {xsum('Q_noncomp')} / 12 > 0"))
def _reactive_missing(spark, sf_dir):
    rows = edp.process_edp(views.edp_readings(spark, sf_dir), rating(spark, sf_dir), missing_voltage="absorb")
    return edp.reactive_ranking(rows)


@register("multi_circuit_sites", with_views("""
SELECT edp_site_id, edp_circuit_label, MIN(datetime) AS datetime, COUNT(*) OVER (PARTITION BY edp_site_id) AS count_circuits
FROM edp_readings WHERE circuit_label = 'pv_site_net' GROUP BY edp_site_id, edp_circuit_label
QUALIFY COUNT(*) OVER (PARTITION BY edp_site_id) > 1""", views=("placed", "ts", "edp_readings")))
def _multi(spark, sf_dir):
    return edp.multi_circuit_sites(views.edp_readings(spark, sf_dir)).select(
        "edp_site_id", "edp_circuit_label", "datetime", "count_circuits")


VIOLATION = "time, edp_site_id, active_power, reactive_power, voltage_avg, P_noncomp, Q_noncomp"


@register("edp_voltwatt_violations", _edp_sql(f"SELECT {VIOLATION} FROM edp WHERE P_noncomp > 0 AND voltage_avg > 250"))
def _vw_violations(spark, sf_dir):
    return edp.voltwatt_violations(processed(spark, sf_dir)).select(*VIOLATION.split(", "))


@register("edp_voltvar_violations", _edp_sql(
    f"SELECT {VIOLATION} FROM edp WHERE Q_noncomp > 0.2 AND voltage_avg > 250 AND reactive_power < -0.5"))
def _vv_violations(spark, sf_dir):
    return edp.voltvar_violations(processed(spark, sf_dir)).select(*VIOLATION.split(", "))


@register("edp_missing_voltage_frequency", _edp_sql("""
SELECT n_missing, COUNT(*) AS n_sites FROM (SELECT edp_site_id, COUNT(*) FILTER (voltage_avg IS NULL) AS n_missing FROM edp
GROUP BY edp_site_id) GROUP BY n_missing"""))
def _missing_voltage(spark, sf_dir):
    return quality.missing_voltage_frequency(processed(spark, sf_dir))


@register("edp_coverage", with_views("""
SELECT edp_site_id, COUNT(t) AS n_rows, COUNT(DISTINCT t) AS n_times, MIN(t) AS min_time, MAX(t) AS max_time
FROM (SELECT edp_site_id, datetime AS t FROM edp_readings) GROUP BY edp_site_id""", views=("placed", "ts", "edp_readings")))
def _edp_coverage(spark, sf_dir):
    return quality.coverage(views.edp_readings(spark, sf_dir), "edp_site_id", "datetime")
