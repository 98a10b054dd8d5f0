"""Registered queries: site power, response bands, conformance and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pvgrid.operators import conformance, fleet, response, sequences
from pvgrid.operators.site import high_voltage, normalise, site_power, site_power_by_role
from pvgrid.plans import views
from pvgrid.plans.registry import register
from pvgrid.plans.sql_views import (YMD, day_night, local_day, mic, npos, q6, site, with_views, xavg, xsum)

BASE = ("placed", "ts", "meta")
V350 = "voltage > 0 AND voltage < 350"
VMAX = f"CAST(MAX({mic('voltage')}) AS DOUBLE) / 1e6"


def canonical_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_power(views.ts(spark, sf_dir), views.meta(spark, sf_dir))


def trip_site(spark: SparkSession, sf_dir: str, v_hi: float = 350) -> DataFrame:
    """Site rows as the trip analyses need them: highest voltage, wider bounds."""
    return site_power(views.ts(spark, sf_dir), views.meta(spark, sf_dir), v_hi=v_hi, v_agg="max",
                      capacity="key", meta_pv_only=False)


SITE = ("site", site())
TRIP_SITE = ("site", site(V350, VMAX, pv_meta=False))


@register("site_power", with_views("SELECT * FROM site", SITE, views=BASE))
def _site_power(spark, sf_dir):
    return canonical_site(spark, sf_dir)


@register("site_power_trip_bounds", with_views("SELECT * FROM site", TRIP_SITE, views=BASE))
def _site_power_trip(spark, sf_dir):
    return trip_site(spark, sf_dir)


@register("site_power_scrubbed_after", with_views(
    "SELECT * FROM site WHERE V BETWEEN 0 AND 300", ("site", site("true")), views=BASE))
def _site_power_scrubbed(spark, sf_dir):
    return site_power(views.ts(spark, sf_dir), views.meta(spark, sf_dir), v_lo=None, v_hi=None,
                      scrub_after=(0, 300))


@register("high_voltage_rows", with_views("SELECT * FROM site WHERE V > 253", SITE, views=BASE))
def _high_voltage(spark, sf_dir):
    return high_voltage(canonical_site(spark, sf_dir))


ROLE = ("role", f"""
SELECT site_id, t_stamp, ac_capacity_kw, {xavg('V')} AS V,
       CAST(SUM(CASE WHEN circuit_type LIKE 'pv_%' THEN P END) AS DOUBLE) / 1e9 AS P_pv,
       CAST(SUM(CASE WHEN circuit_type = 'ac_load_net' THEN P END) AS DOUBLE) / 1e9 AS P_net,
       CAST(SUM(CASE WHEN circuit_type NOT LIKE 'pv_%' AND circuit_type <> 'ac_load_net' THEN P END) AS DOUBLE) / 1e9
         AS P_other
FROM (SELECT site_id, t_stamp, circuit_type, ac_capacity_kw, {xavg('voltage')} AS V,
             SUM({mic('power * circuit_polarity')}) AS P
      FROM ts JOIN (SELECT DISTINCT circuit_id, site_id, circuit_polarity, circuit_type, ac_capacity_kw FROM meta) m
        USING (circuit_id) WHERE voltage > 0 AND voltage < 300 GROUP BY ALL)
GROUP BY site_id, t_stamp, ac_capacity_kw""")


@register("site_power_by_role", with_views(
    "SELECT site_id, t_stamp, ac_capacity_kw, V, P_pv, P_net, P_other FROM role", ROLE, views=BASE))
def _by_role(spark, sf_dir):
    return site_power_by_role(views.ts(spark, sf_dir), views.meta(spark, sf_dir))


@register("normalised_power", with_views(
    "SELECT site_id, t_stamp, p AS P_kw_norm, q AS Q_kvar_norm, sqrt(p * p + q * q) AS S_norm FROM "
    "(SELECT site_id, t_stamp, P_kW / S_99 AS p, Q_kvar / S_99 AS q FROM site)", SITE, views=BASE))
def _normalised(spark, sf_dir):
    return normalise(canonical_site(spark, sf_dir)).select(
        "site_id", "t_stamp", "P_kw_norm", "Q_kvar_norm", "S_norm")


S = "ac_capacity_kw"
LIMIT = (f"CASE WHEN V < 253 THEN {S} WHEN V > 260 THEN 0.2e0 * {S} "
         f"ELSE ({S} - 0.2e0 * {S}) / -7e0 * (V - 260e0) + 0.2e0 * {S} END")

BANDS = ("bands", f"""
SELECT *, CASE WHEN Q_max + Q_min = 0 THEN 1e0 ELSE sign(CASE WHEN ru <= rl THEN Q_max ELSE Q_min END) * sign(Q_kvar) END
          * CASE WHEN ru <= rl THEN ru ELSE rl END AS Q_impact
FROM (SELECT *, abs(Q_kvar) / (abs(Q_max) + 1e-9) AS ru, abs(Q_kvar) / (abs(Q_min) + 1e-9) AS rl
FROM (SELECT *, CASE WHEN hi < 0 THEN greatest(hi, 0.04e0 * {S} - Q_cap) ELSE hi END AS Q_max,
             CASE WHEN lo > 0 THEN least(lo, Q_cap - 0.04e0 * {S}) ELSE lo END AS Q_min
FROM (SELECT *, Q_set + 0.04e0 * {S} AS hi, Q_set - 0.04e0 * {S} AS lo
FROM (SELECT *, {LIMIT} AS P_limit,
        CASE WHEN V < 207 THEN 0.44e0 * {S} WHEN V < 220 THEN 0.44e0 * {S} / -13e0 * (V - 220e0)
             WHEN V <= 240 THEN 0e0 WHEN V < 258 THEN 0.6e0 * {S} / -18e0 * (V - 258e0) - 0.6e0 * {S}
             ELSE -(0.6e0 * {S}) END AS Q_set,
        CASE WHEN abs(P_kW) < 0.2e0 * {S} THEN 0e0 WHEN abs(P_kW) <= 0.6e0 * {S} THEN 0.44e0 * {S}
             WHEN abs(P_kW) <= 0.8e0 * {S}
               THEN sqrt(greatest(0e0, (abs(P_kW) / 0.8e0) * (abs(P_kW) / 0.8e0) - abs(P_kW) * abs(P_kW)))
             ELSE sqrt(greatest(0e0, {S} * {S} - abs(P_kW) * abs(P_kW))) END AS Q_cap
FROM site))))""")


@register("response_bands", with_views(
    "SELECT site_id, t_stamp, P_limit, Q_set, Q_cap, Q_max, Q_min, Q_impact FROM bands", SITE, BANDS, views=BASE))
def _bands(spark, sf_dir):
    return response.response_bands(canonical_site(spark, sf_dir)).select(
        "site_id", "t_stamp", "P_limit", "Q_set", "Q_cap", "Q_max", "Q_min", "Q_impact")


VOLTWATT = ("vw", f"SELECT *, greatest(0e0, P_kW - P_limit) AS excess, {YMD} FROM "
                  f"(SELECT *, ({LIMIT}) + 0.04e0 * {S} AS P_limit FROM site WHERE V > 253)")


VOLTWATT_DAILY = ("vw_daily", f"""
SELECT year, month, day, site_id, {xsum('P_kW')} AS P_kW_sum, {xsum('excess')} AS nonconformance_voltwatt_sum,
       {npos('excess')} AS nonconformance_voltwatt_count, COUNT(excess) AS total_count
FROM vw GROUP BY year, month, day, site_id""")


@register("voltwatt_conformance", with_views("SELECT * FROM vw_daily", SITE, VOLTWATT, VOLTWATT_DAILY, views=BASE))
def voltwatt(spark, sf_dir):
    return conformance.voltwatt_conformance(canonical_site(spark, sf_dir))


DEVIATION = ("dev", f"""
SELECT *, Q_adverse + Q_inactive + Q_minor_deviation + Q_major_deficit + Q_major_surplus AS deviation
FROM (SELECT *,
  CASE WHEN o AND Q_impact < -0.1e0 THEN dist ELSE 0e0 END AS Q_adverse,
  CASE WHEN o AND Q_impact BETWEEN -0.1e0 AND 0.1e0 THEN dist ELSE 0e0 END AS Q_inactive,
  CASE WHEN o AND Q_impact > 0.1e0 AND Q_impact < 0.9e0 THEN dist ELSE 0e0 END AS Q_minor_deviation,
  CASE WHEN o AND Q_impact BETWEEN 0.9e0 AND 1.1e0 THEN dist ELSE 0e0 END AS Q_major_deficit,
  CASE WHEN o AND Q_impact > 1.1e0 THEN dist ELSE 0e0 END AS Q_major_surplus
FROM (SELECT *, Q_kvar < Q_min OR Q_kvar > Q_max AS o, least(abs(Q_kvar - Q_min), abs(Q_kvar - Q_max)) AS dist
FROM bands))""")

CLASSES = ("Q_adverse", "Q_inactive", "Q_minor_deviation", "Q_major_deficit", "Q_major_surplus")


def voltvar_sql(source: str) -> str:
    measures = ("nonconformance_voltvar", *CLASSES, "curtailment_voltvar")
    sums = ", ".join(f"{xsum(m)} AS {m}_sum" for m in measures[:-1])
    sums += f", {q6('SUM(curtailment_voltvar)')} AS curtailment_voltvar_sum"
    counts = ", ".join(f"{npos(m)} AS {m}_count" for m in measures)
    return (f"SELECT year, month, day, day_night, site_id, {xsum('P_kW')} AS P_kW_sum, {sums}, {counts}, "
            f"COUNT(nonconformance_voltvar) AS total_count FROM {source} "
            "GROUP BY year, month, day, day_night, site_id")


def voltvar_rows_sql(uncurtailed: str, join: str = "") -> str:
    return f"""SELECT dev.*, deviation AS nonconformance_voltvar, {day_night('dev.t_stamp')} AS day_night,
  year(dev.t_stamp) AS year, month(dev.t_stamp) AS month, day(dev.t_stamp) AS day,
  CASE WHEN dev.V <= 253 AND sqrt(dev.P_kW * dev.P_kW + Q_kvar * Q_kvar) >= S_99
       THEN {uncurtailed} - dev.P_kW END AS curtailment_voltvar
FROM dev {join}"""


VOLTVAR_ROWS = ("vv", voltvar_rows_sql("CAST(NULL AS DOUBLE)"))
VOLTVAR = ("conf", voltvar_sql("vv"))


@register("voltvar_conformance", with_views("SELECT * FROM conf", SITE, BANDS, DEVIATION, VOLTVAR_ROWS, VOLTVAR,
                                            views=BASE))
def voltvar(spark, sf_dir):
    return conformance.voltvar_conformance(canonical_site(spark, sf_dir))


RED = ("red", "SELECT *, Q_adverse_sum + Q_inactive_sum + Q_major_deficit_sum AS nonconformance_voltvar_red_sum, "
              "Q_adverse_count + Q_inactive_count + Q_major_deficit_count AS nonconformance_voltvar_red_count FROM conf")


@register("voltvar_red", with_views("SELECT * FROM red", SITE, BANDS, DEVIATION, VOLTVAR_ROWS, VOLTVAR, RED, views=BASE))
def voltvar_red(spark, sf_dir):
    return conformance.voltvar_red(voltvar(spark, sf_dir))


LOCAL_9_16 = "CASE WHEN hour(t_stamp + INTERVAL 10 HOUR) BETWEEN 9 AND 16 THEN 'day' ELSE 'night' END"
DIRECTIONS = {
    "extra_absorb": ("Q_kvar < 0 AND Q_kvar < Q_min", "Q_min - Q_kvar"),
    "deficit_absorb": ("Q_kvar < 0 AND Q_kvar > Q_max", "Q_kvar - Q_max"),
    "extra_supply": ("Q_kvar > 0 AND Q_kvar > Q_max", "Q_kvar - Q_max"),
    "deficit_supply": ("Q_kvar > 0 AND Q_kvar < Q_min", "Q_min - Q_kvar"),
}
SEVERITY = {"adv_high": "Q_impact < -0.5e0", "adv_low": "Q_impact >= -0.5e0 AND Q_impact < 0",
            "ben_low": "Q_impact >= 0 AND Q_impact < 1.25e0", "ben_high": "Q_impact >= 1.25e0"}


def _class_sql(parts: dict[str, tuple[str, str]]) -> str:
    cols = ", ".join(f"CASE WHEN {c} THEN {x} ELSE 0e0 END AS {n}" for n, (c, x) in parts.items())
    sums = ", ".join(f"{xsum(n)} AS Q_{n}, {npos(n)} AS Q_{n}_count" for n in parts)
    rows = (f"SELECT *, {' + '.join(parts)} AS nc, {YMD}, {LOCAL_9_16} AS day_night FROM (SELECT *, {cols} FROM bands)")
    return (f"SELECT year, month, day, day_night, site_id, {npos('nc')} AS noncompliance_voltvar_count, "
            f"{xsum('nc')} AS noncompliance_voltvar_sum, {sums}, COUNT(nc) AS total_count "
            f"FROM ({rows}) GROUP BY year, month, day, day_night, site_id")


@register("voltvar_direction_classes", with_views(_class_sql(DIRECTIONS), SITE, BANDS, views=BASE))
def _directions(spark, sf_dir):
    return conformance.voltvar_direction_classes(canonical_site(spark, sf_dir))


@register("voltvar_direction_severity_classes", with_views(_class_sql(
    {f"{d}_{s}": (f"{c} AND {sc}", x) for d, (c, x) in DIRECTIONS.items() for s, sc in SEVERITY.items()}),
    SITE, BANDS, views=BASE))
def _severity(spark, sf_dir):
    return conformance.voltvar_direction_severity_classes(canonical_site(spark, sf_dir))


@register("conformant_site_count", with_views(
    "SELECT COUNT(*) AS n_sites FROM (SELECT site_id FROM conf GROUP BY site_id "
    "HAVING CAST(SUM(nonconformance_voltvar_count) AS DOUBLE) / CAST(SUM(total_count) AS DOUBLE) <= 0.9e0)",
    SITE, BANDS, DEVIATION, VOLTVAR_ROWS, VOLTVAR, views=BASE))
def _conformant_sites(spark, sf_dir):
    return conformance.conformant_site_count(voltvar(spark, sf_dir), threshold=0.9)


@register("conformant_site_count_at_default", with_views(
    "SELECT COUNT(*) AS n_sites FROM (SELECT SUM(nonconformance_voltvar_count) AS bad, SUM(total_count) AS n FROM conf GROUP BY site_id) "
    "WHERE n > 0 AND bad / CAST(n AS DOUBLE) <= 0.1e0", SITE, BANDS, DEVIATION, VOLTVAR_ROWS, VOLTVAR, views=BASE))
def _conformant_sites_default(spark, sf_dir):
    return conformance.conformant_site_count(voltvar(spark, sf_dir))


# --- sequences -----------------------------------------------------------------

def _lag(c: str, k: int) -> str:
    return f"lag({c}, {k}) OVER w"


LAGS = ("lags", "SELECT *, " + ", ".join(
    f"{_lag('V', k)} AS v{k}, {_lag('P_kW', k)} AS p{k}" for k in (1, 2, 3)) +
    f", 0.04e0 * {S} AS fl, {day_night('t_stamp')} AS day_night, {YMD} FROM site "
    "WINDOW w AS (PARTITION BY site_id, year(t_stamp), month(t_stamp) ORDER BY t_stamp)")

CONDITIONS = {
    "two_sample": "V >= thr AND v1 >= thr AND (P_kW > fl OR p1 > fl OR p2 > fl)",
    "one_sample_or_power": "V >= thr AND (v1 >= thr OR p1 > fl OR P_kW > fl)",
    "voltage_only": "V >= thr",
    "sustained": "V >= thr AND v1 >= thr AND (v2 >= thr OR p2 > fl OR P_kW > fl)",
    "sustained_3w": "V >= thr AND v1 >= thr AND v2 >= thr AND (P_kW > fl OR p1 > fl OR p2 > fl OR p3 > fl)",
}


def _sweep_sql(rule: str, thresholds, prefix: str, day_only: bool = False) -> str:
    thr = ", ".join(f"{v}e0" for v in thresholds)
    return f"""
SELECT year, month, day, day_night, site_id, thr AS v_threshold, {xsum('ex')} AS {prefix}_sum,
       {npos('ex')} AS {prefix}_count, COUNT(ex) AS total_count
FROM (SELECT *, CASE WHEN P_kW >= fl THEN P_kW - fl ELSE 0e0 END AS ex
      FROM lags, (SELECT unnest([{thr}]) AS thr)
      WHERE {CONDITIONS[rule]} {"AND day_night = 'day'" if day_only else ""})
GROUP BY year, month, day, day_night, site_id, thr"""


AI, SO = sequences.ANTI_ISLANDING_THRESHOLDS, sequences.SUSTAINED_THRESHOLDS
AI_SQL = _sweep_sql("two_sample", AI, "nonconformance_antiisland")
SO3_SQL = _sweep_sql("sustained_3w", SO, "nonconformance_sust_op_3w", True)


@register("anti_islanding_conformance", with_views(AI_SQL, TRIP_SITE, LAGS, views=BASE))
def anti_islanding(spark, sf_dir):
    return sequences.anti_islanding_conformance(trip_site(spark, sf_dir))


SITE_300 = ("site", site(volts=VMAX, pv_meta=False))


@register("anti_islanding_one_sample_or_power", with_views(
    _sweep_sql("one_sample_or_power", (265,), "nonconformance"), SITE_300, LAGS, views=BASE))
def _ai_one(spark, sf_dir):
    return sequences.threshold_sweep(trip_site(spark, sf_dir, 300), (265,), "one_sample_or_power")


@register("anti_islanding_voltage_only", with_views(
    _sweep_sql("voltage_only", (265,), "nonconformance"), SITE_300, LAGS, views=BASE))
def _ai_voltage(spark, sf_dir):
    return sequences.threshold_sweep(trip_site(spark, sf_dir, 300), (265,), "voltage_only")


@register("sustained_operation", with_views(
    _sweep_sql("sustained", SO, "nonconformance_sust_op", True), TRIP_SITE, LAGS, views=BASE))
def sustained(spark, sf_dir):
    return sequences.sustained_operation(trip_site(spark, sf_dir))


@register("sustained_operation_3w", with_views(SO3_SQL, TRIP_SITE, LAGS, views=BASE))
def sustained_3w(spark, sf_dir):
    return sequences.sustained_operation_3w(trip_site(spark, sf_dir))


@register("threshold_sweep_sites", with_views(
    "SELECT v_threshold, COUNT(DISTINCT site_id) AS n_sites, COUNT(*) AS n_rows FROM ai GROUP BY v_threshold",
    TRIP_SITE, LAGS, ("ai", AI_SQL), views=BASE))
def _by_threshold(spark, sf_dir):
    return sequences.sites_by_threshold(anti_islanding(spark, sf_dir))


@register("fully_conformant_days", with_views(f"""
SELECT * FROM (SELECT year, month, day, site_id, {xsum('P_kW')} AS P_kW_sum, {xsum('excess')} AS nonconformance_voltwatt_sum,
       {npos('excess')} AS nonconformance_voltwatt_count, COUNT(excess) AS total_count
FROM vw GROUP BY year, month, day, site_id) WHERE total_count > 5 AND nonconformance_voltwatt_count = 0""",
    SITE, VOLTWATT, views=BASE))
def _fully_conformant(spark, sf_dir):
    return conformance.fully_conformant_days(voltwatt(spark, sf_dir), "nonconformance_voltwatt_count")


FLEX_SITE = ("site", site("voltage >= 0 AND voltage <= 300"))
FLEX_ROWS = ("fx", f"""
SELECT *, greatest(P_kW, p1, p2, p3, p4) - least(P_kW, p1, p2, p3, p4) AS spread
FROM (SELECT *, MAX(P_kW) OVER (PARTITION BY site_id, day) AS pmax, {', '.join(f'lag(P_kW, {k}) OVER w AS p{k}' for k in (1, 2, 3, 4))}
      FROM (SELECT *, {local_day('t_stamp')} AS day FROM site)
      WINDOW w AS (PARTITION BY site_id, day ORDER BY t_stamp))
WHERE P_kW >= 0.2e0 * {S} AND {S} >= 5 AND p4 IS NOT NULL AND P_kW <= 0.75e0 * pmax""")


def flex_site(spark, sf_dir, v_lo: float = 0, cell: bool = False) -> DataFrame:
    return site_power(views.ts(spark, sf_dir), views.meta(spark, sf_dir), v_lo=v_lo, v_hi=300, inclusive=True,
                      cell=cell)


@register("flex_export_sites", with_views(
    "SELECT site_id, day FROM fx GROUP BY site_id, day HAVING MIN(spread) < 0.004e0", FLEX_SITE, FLEX_ROWS, views=BASE))
def flex_sites(spark, sf_dir):
    return sequences.flex_export_sites(flex_site(spark, sf_dir))


@register("flex_export_rows", with_views(
    "SELECT site_id, t_stamp, P_kW FROM fx WHERE P_kW < 0.75e0 * pmax AND spread < 0.004e0",
    ("site", site("voltage >= 200 AND voltage <= 300")), FLEX_ROWS, views=BASE))
def _flex_rows(spark, sf_dir):
    return sequences.flex_export_rows(flex_site(spark, sf_dir, 200))


@register("flag_flex_export", with_views(
    "SELECT circuit_id, site_id, site_id IN (SELECT site_id FROM fx GROUP BY site_id, day HAVING MIN(spread) < 0.004e0) "
    "AS flex_export_detected FROM meta", FLEX_SITE, FLEX_ROWS, views=BASE))
def _flag_flex(spark, sf_dir):
    flagged = sequences.flag_flex_export(views.meta(spark, sf_dir), flex_sites(spark, sf_dir))
    return flagged.select("circuit_id", "site_id", "flex_export_detected")


# --- fleet reports -------------------------------------------------------------

IN_SCOPE = f"manufacturer IN {fleet.MANUFACTURERS!r} AND dnsp_name IN {fleet.NETWORKS!r}"


@register("oem_sites", with_views(
    "SELECT DISTINCT site_id, state, dnsp_name, CASE manufacturer WHEN 'Goodwe' THEN 'GoodWe' "
    "WHEN 'Solaredge' THEN 'SolarEdge' WHEN 'SolaX Power' THEN 'SolaX' ELSE manufacturer END AS OEM "
    f"FROM meta WHERE {IN_SCOPE}", views=("meta",)))
def _oem_sites(spark, sf_dir):
    return fleet.oem_sites(views.meta(spark, sf_dir))


@register("oem_counts", with_views(
    "SELECT state, dnsp_name, manufacturer, COUNT(DISTINCT site_id) AS n_sites FROM meta "
    f"WHERE {IN_SCOPE} GROUP BY ALL", views=("meta",)))
def _oem_counts(spark, sf_dir):
    return fleet.oem_counts(views.meta(spark, sf_dir))


def _oem_rate_sql(limit: str) -> str:
    return with_views("""
SELECT maker AS OEM, quarter_name AS install_date, good AS num_conf_sites, bad AS num_nonconf_sites,
       100e0 * (bad / CAST(good + bad AS DOUBLE)) AS nonconf_install_ratio_pct
FROM (SELECT maker, quarter_name, COUNT(*) FILTER (verdict = 0) AS good, COUNT(*) FILTER (verdict = 1) AS bad
      FROM verdicts JOIN installed USING (site_id) GROUP BY maker, quarter_name)
WHERE bad > 0 AND maker <> 'Generic Inverter'""",
    SITE, BANDS, DEVIATION, VOLTVAR_ROWS, VOLTVAR, RED, ("installed", """
SELECT site_id, MIN(manufacturer) AS maker, MIN(strftime(pv_install_date, '%Y') || '-Q' || quarter(pv_install_date)) AS quarter_name
FROM meta WHERE year(pv_install_date) > 2023 GROUP BY site_id"""), ("verdicts", """
SELECT site_id, CASE WHEN SUM(nonconformance_voltvar_red_count) / CAST(SUM(total_count) AS DOUBLE) > @limit THEN 1 ELSE 0 END AS verdict
FROM red GROUP BY site_id HAVING SUM(total_count) > 0"""), views=BASE).replace("@limit", limit)


@register("oem_install_quarter_rate", _oem_rate_sql("0.3e0"))
def _oem_quarter(spark, sf_dir):
    return fleet.oem_install_quarter_rate(voltvar_red(spark, sf_dir), views.meta(spark, sf_dir), threshold=0.3)


@register("oem_install_quarter_rate_at_default", _oem_rate_sql("0.1e0"))
def _oem_quarter_default(spark, sf_dir):
    return fleet.oem_install_quarter_rate(voltvar_red(spark, sf_dir), views.meta(spark, sf_dir))


@register("state_voltage", with_views(f"""
SELECT state, COUNT(*) AS n, {xavg('V')} AS V_mean, quantile_disc(V, 0.01) AS V_01, quantile_disc(V, 0.5) AS V_50,
       quantile_disc(V, 0.99) AS V_99
FROM (SELECT site_id, state, t_stamp, {xavg('voltage')} AS V FROM ts JOIN (SELECT DISTINCT circuit_id, site_id, state FROM meta) m
      USING (circuit_id) WHERE is_pv AND voltage BETWEEN 180 AND 265 AND (hour(t_stamp) BETWEEN 0 AND 6 OR hour(t_stamp) >= 22)
      GROUP BY ALL) GROUP BY state""", views=BASE))
def _state_voltage(spark, sf_dir):
    return fleet.state_voltage(views.ts(spark, sf_dir), views.meta(spark, sf_dir))


@register("site_profile", with_views(f"""
SELECT site_id, quantile_disc(S, 0.99) AS S_99, quantile_disc(PF, 0.01) AS pf_01, quantile_disc(V, 0.01) AS v_01,
       quantile_disc(V, 0.05) AS v_05, quantile_disc(V, 0.95) AS v_95, quantile_disc(V, 0.99) AS v_99,
       {xavg('PF')} AS avg_pf, MIN(t_stamp) AS min_time, MAX(t_stamp) AS max_time
FROM (SELECT *, sqrt(P_kW * P_kW + Q_kvar * Q_kvar) AS S, CASE WHEN P_kW > 0.2e0 * ac_capacity_kw AND (V > 240 OR V < 220)
        THEN {q6('P_kW / sqrt(P_kW * P_kW + Q_kvar * Q_kvar)')} END AS PF FROM (SELECT * EXCLUDE (S_99) FROM site))
GROUP BY site_id""", SITE, views=BASE))
def _site_profile(spark, sf_dir):
    return fleet.site_profile(views.ts(spark, sf_dir), views.meta(spark, sf_dir))
