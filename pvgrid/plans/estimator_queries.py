"""Registered queries: solar grid, clear sky, estimator and curtailment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvgrid.functions.exact import quantise
from pvgrid.operators import clearsky, conformance, estimator, sequences, weather
from pvgrid.operators.site import site_power
from pvgrid.plans import views
from pvgrid.plans.chain import Fitted, HandOff
from pvgrid.plans.conformance_queries import (BANDS, BASE, DEVIATION, FLEX_ROWS, SITE, VOLTWATT, flex_site, voltvar_rows_sql,
                                              voltvar_sql)
from pvgrid.plans.registry import register
from pvgrid.plans.sql_views import local_day, npos, q6, site, tod, with_views, xavg, xsum
from pvgrid.session import forget, kept, stage, tasks_for

SOLAR_BASE = (*BASE, "solar")
CELLS = ("cells", "SELECT DISTINCT site_id, n_lat AS latitude, n_long AS longitude FROM meta "
                  "WHERE is_pv AND NOT flex_export_detected")
GRID = ("grid", "SELECT DISTINCT time, latitude, longitude, GHI, cloud_type FROM solar "
                "JOIN (SELECT DISTINCT latitude, longitude FROM cells) USING (latitude, longitude)")
HELD = ("held", "SELECT time AS t_stamp, latitude, longitude, GHI, cloud_type FROM grid UNION ALL "
                "SELECT time + INTERVAL 5 MINUTE, latitude, longitude, GHI, cloud_type FROM grid")
DAILY = ("daily", f"SELECT latitude, longitude, {local_day('time')} AS day, CAST(SUM(cloud_type) AS BIGINT) AS cloud_sum, "
                  "MAX(GHI) AS max_GHI FROM grid GROUP BY ALL")
CLEAR = ("clear", """SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY latitude, longitude, date_trunc('month', day) ORDER BY cloud_sum, day) AS rn FROM daily)
WHERE rn < 4 AND cloud_sum < 60 AND max_GHI > 200""")
ROWS = ("rows_", f"""SELECT s.*, latitude, longitude, P_kW / S_99 AS P_kw_norm, Q_kvar / S_99 AS Q_kvar_norm,
  sqrt(P_kW / S_99 * (P_kW / S_99) + Q_kvar / S_99 * (Q_kvar / S_99)) AS S_norm, {local_day('t_stamp')} AS day,
  {tod('t_stamp')} AS tod FROM site s JOIN cells USING (site_id)""")
NEAREST = ("nearest", """SELECT * FROM (SELECT d.latitude, d.longitude, d.day AS actual_day, c.day AS cs_day,
    row_number() OVER (PARTITION BY d.latitude, d.longitude, d.day ORDER BY abs(c.day - d.day), d.day - c.day) AS rn
  FROM (SELECT DISTINCT latitude, longitude, day FROM rows_) d JOIN clear c
    ON c.latitude = d.latitude AND c.longitude = d.longitude) WHERE rn = 1""")
SEGMENTS = ("segs", """SELECT *, CAST(SUM(gap) OVER (PARTITION BY site_id, day ORDER BY t_stamp ROWS UNBOUNDED PRECEDING) AS BIGINT)
  AS segment_id FROM (SELECT *, CASE WHEN epoch(t_stamp) - epoch(lag(t_stamp) OVER
    (PARTITION BY site_id, day ORDER BY t_stamp)) > 1800 THEN 1 ELSE 0 END AS gap FROM rows_)""")
PROFILE = ("profile", """SELECT site_id, s.day AS cs_day, tod AS cs_tod, quantile_disc(P_kw_norm, 0.6) OVER w AS P_kw_norm_cs,
    quantile_disc(GHI, 0.6) OVER w AS GHI_cs, cloud_type AS cloud_type_cs
  FROM segs s JOIN (SELECT DISTINCT latitude, longitude, cs_day FROM nearest) n
    ON s.latitude = n.latitude AND s.longitude = n.longitude AND s.day = n.cs_day
  JOIN held h ON h.latitude = s.latitude AND h.longitude = s.longitude AND h.t_stamp = s.t_stamp
  WINDOW w AS (PARTITION BY site_id, s.day, segment_id ORDER BY s.t_stamp ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
STRUCTURED = ("structured", """SELECT r.site_id, r.t_stamp, r.day AS actual_day, r.tod AS actual_tod, V, Q_kvar_norm, P_kw_norm,
    S_norm, GHI, cloud_type, p.cs_day, cs_tod, P_kw_norm_cs, GHI_cs, cloud_type_cs, S_99, year(r.t_stamp) AS year,
    month(r.t_stamp) AS month
  FROM rows_ r JOIN nearest n ON n.latitude = r.latitude AND n.longitude = r.longitude AND n.actual_day = r.day
    AND abs(n.cs_day - n.actual_day) < 45
  JOIN held h ON h.latitude = r.latitude AND h.longitude = r.longitude AND h.t_stamp = r.t_stamp
  JOIN profile p ON p.site_id = r.site_id AND p.cs_day = n.cs_day AND p.cs_tod = r.tod""")
SKY = (SITE, CELLS, GRID, HELD, DAILY, CLEAR, ROWS, NEAREST, SEGMENTS, PROFILE, STRUCTURED)


def eligible_meta(spark, sf_dir) -> DataFrame:
    return views.meta(spark, sf_dir).where("is_pv AND NOT flex_export_detected")


def cells(spark, sf_dir) -> DataFrame:
    return clearsky.site_cells(eligible_meta(spark, sf_dir))


def grid(spark, sf_dir) -> DataFrame:
    return clearsky.grid_of_sites(views.solar(spark, sf_dir), cells(spark, sf_dir))


def eligible_site(spark, sf_dir) -> DataFrame:
    readings = views.ts(spark, sf_dir)
    return site_power(readings, eligible_meta(spark, sf_dir), cell=True, tasks=tasks_for(readings))


def structured(spark, sf_dir) -> DataFrame:
    return clearsky.structured_data(eligible_site(spark, sf_dir), grid(spark, sf_dir))


# --- solar grid and clear sky --------------------------------------------------

@register("solar_by_postcode", with_views(f"""
SELECT time, p.postcode, {xavg('GHI')} AS GHI, {xavg('cloud_type')} AS cloud_type
FROM solar s JOIN (SELECT CAST(-(10 + n_nationkey) AS DOUBLE) + 0.002e0 AS la, CAST(120 + n_nationkey AS DOUBLE) - 0.004e0 AS lo,
       CAST(3000 + n_nationkey % 7 AS BIGINT) AS postcode FROM nation) p
  ON CAST(floor(latitude * 100 + 0.5e0) AS BIGINT) = CAST(floor(la * 100 + 0.5e0) AS BIGINT)
 AND CAST(floor(longitude * 100 + 0.5e0) AS BIGINT) = CAST(floor(lo * 100 + 0.5e0) AS BIGINT)
WHERE GHI IS NOT NULL GROUP BY time, p.postcode""", views=("solar",)))
def _solar_by_postcode(spark, sf_dir):
    n = F.col("n_nationkey")
    points = views.table(spark, sf_dir, "nation").select(
        ((-(n + 10)).cast("double") + F.lit(0.002)).alias("latitude"),
        ((n + 120).cast("double") - F.lit(0.004)).alias("longitude"), (n % 7 + 3000).alias("postcode"))
    solar = views.solar(spark, sf_dir).drop("postcode")
    return clearsky.solar_by_postcode(solar, points, ("GHI", "cloud_type"), required="GHI")


@register("hold_to_5min", with_views("SELECT * FROM held", CELLS, GRID, HELD, views=("meta", "solar")))
def _held(spark, sf_dir):
    return clearsky.hold_to_5min(grid(spark, sf_dir)).withColumnRenamed("time_5min", "t_stamp")


@register("clear_sky_days", with_views("SELECT * FROM clear", CELLS, GRID, DAILY, CLEAR, views=("meta", "solar")))
def _clear_days(spark, sf_dir):
    return clearsky.clear_sky_days(grid(spark, sf_dir))


@register("cloudless_clear_sky_days", with_views("""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY latitude, longitude, date_trunc('month', day) ORDER BY cloud_sum, day) AS rn
FROM daily) WHERE rn < 30 AND cloud_sum = 0 AND max_GHI > 200""", CELLS, GRID, DAILY, views=("meta", "solar")))
def _cloudless(spark, sf_dir):
    return clearsky.clear_sky_days(grid(spark, sf_dir), max_rank=29, cloudless=True)


@register("nearest_clear_sky_day", with_views(
    "SELECT latitude, longitude, actual_day, cs_day FROM nearest", SITE, CELLS, GRID, DAILY, CLEAR, ROWS, NEAREST, views=SOLAR_BASE))
def _nearest(spark, sf_dir):
    rows = eligible_site(spark, sf_dir)
    days = rows.select("latitude", "longitude", clearsky.local_day(F.col("t_stamp")).alias("day")).distinct()
    return clearsky.nearest_clear_sky_day(days, clearsky.clear_sky_days(grid(spark, sf_dir)))


@register("segment_gaps", with_views("SELECT site_id, t_stamp, day, segment_id FROM segs", SITE, CELLS, ROWS, SEGMENTS, views=BASE))
def _segments(spark, sf_dir):
    return clearsky.segment_gaps(eligible_site(spark, sf_dir)).select("site_id", "t_stamp", "day", "segment_id")


@register("clear_sky_profile", with_views("SELECT * FROM profile", *SKY[:-1], views=SOLAR_BASE))
def _profile(spark, sf_dir):
    g = grid(spark, sf_dir)
    rows = clearsky.with_irradiance(clearsky.normalise(eligible_site(spark, sf_dir)), clearsky.hold_to_5min(g))
    return clearsky.clear_sky_profile(rows, clearsky.clear_sky_days(g))


@register("structured_data", with_views("SELECT * FROM structured", *SKY, views=SOLAR_BASE))
def _structured(spark, sf_dir):
    return structured(spark, sf_dir)


@register("clear_period_counts", with_views("""
SELECT postcode, CAST(SUM(CASE WHEN c = 0 THEN 1 ELSE 0 END) AS BIGINT) AS num_clear_days
FROM (SELECT time, postcode, SUM(cloud_type) AS c FROM solar GROUP BY ALL) GROUP BY postcode""", views=("solar",)))
def _clear_periods(spark, sf_dir):
    return clearsky.clear_period_counts(views.solar(spark, sf_dir))


ZERO_DAYS = ("zero_days", "SELECT latitude, longitude, day FROM daily WHERE cloud_sum = 0")
PEAKS = ("peaks", """SELECT r.site_id, r.day, MAX(GHI) AS max_GHI, MAX(P_kW) AS max_P_kw
FROM rows_ r JOIN zero_days z ON z.latitude = r.latitude AND z.longitude = r.longitude AND z.day = r.day
LEFT JOIN held h ON h.latitude = r.latitude AND h.longitude = r.longitude AND h.t_stamp = r.t_stamp GROUP BY r.site_id, r.day""")
PEAK_SITE = ("site", site("voltage >= 200 AND voltage <= 300"))
PEAK_CELLS = ("cells", "SELECT DISTINCT site_id, n_lat AS latitude, n_long AS longitude FROM meta WHERE is_pv")
PEAK_CTES = (PEAK_SITE, PEAK_CELLS, GRID, HELD, DAILY, ZERO_DAYS, ROWS, PEAKS)


def peaks(spark, sf_dir) -> DataFrame:
    """Peaks of all PV sites; flexible export is no reason to leave a site out here."""
    meta = views.meta(spark, sf_dir).where("is_pv")
    rows = site_power(views.ts(spark, sf_dir), meta, v_lo=200, inclusive=True, cell=True)
    return clearsky.clear_day_peaks(rows, clearsky.grid_of_sites(views.solar(spark, sf_dir), clearsky.site_cells(meta)))


@register("clear_day_peaks", with_views("SELECT * FROM peaks", *PEAK_CTES, views=SOLAR_BASE))
def _peaks(spark, sf_dir):
    return peaks(spark, sf_dir)


FLEX_CELLS = ("cells", "SELECT DISTINCT site_id, n_lat AS latitude, n_long AS longitude FROM meta WHERE is_pv AND site_id IN "
                       "(SELECT site_id FROM fx GROUP BY site_id, day HAVING MIN(spread) < 0.004e0)")


@register("clear_day_series", with_views("""
SELECT site_id, s.t_stamp, P_kW, Q_kvar, V, sqrt(P_kW * P_kW + Q_kvar * Q_kvar) AS S_kva,
       P_kW / nullif(sqrt(P_kW * P_kW + Q_kvar * Q_kvar), 0) AS pf, GHI, cloud_type, ac_capacity_kw, segment_id,
       quantile_disc(P_kW, 0.6) OVER w AS P_est
FROM segs s JOIN clear c ON c.latitude = s.latitude AND c.longitude = s.longitude AND c.day = s.day
JOIN held h ON h.latitude = s.latitude AND h.longitude = s.longitude AND h.t_stamp = s.t_stamp
WINDOW w AS (PARTITION BY site_id, s.day, segment_id ORDER BY s.t_stamp ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
    ("site", site("voltage >= 0 AND voltage <= 300")), FLEX_ROWS, FLEX_CELLS, GRID, HELD, DAILY, CLEAR, ROWS, SEGMENTS,
    views=SOLAR_BASE))
def _series(spark, sf_dir):
    rows = stage(flex_site(spark, sf_dir, cell=True), "site-rows")
    chosen = stage(rows.join(sequences.flex_export_sites(rows).select("site_id").distinct(), "site_id", "left_semi"), "chosen-rows")
    chosen_cells = chosen.select("latitude", "longitude").distinct()
    return clearsky.clear_day_series(chosen, clearsky.grid_of_sites(views.solar(spark, sf_dir), chosen_cells))


DETECTED = ("detected", f"""SELECT station, date, {xavg('step')} AS mean_step, MAX(ghi_mean) AS max_ghi,
  coalesce({xavg('step')} < 25 AND MAX(ghi_mean) >= 500, false) AS is_clear_algo
FROM (SELECT *, abs(ghi_mean - lag(ghi_mean) OVER (PARTITION BY station, date ORDER BY time)) AS step FROM daily_ghi)
GROUP BY station, date""")


def detected(spark, sf_dir) -> DataFrame:
    return clearsky.detect_clear_sky_day(views.daily_ghi(spark, sf_dir), ("station", "date"))


@register("detect_clear_sky_day", with_views("SELECT * FROM detected", DETECTED, views=("daily_ghi",)))
def _detected(spark, sf_dir):
    return detected(spark, sf_dir)


@register("clear_sky_agreement", with_views("""
SELECT l.station || '/' || l.date AS date, unsure, is_clear, is_clear_algo, is_clear <> is_clear_algo AS diff
FROM clear_labels l JOIN detected d ON d.station = l.station AND d.date = l.date""", DETECTED, views=("daily_ghi", "clear_labels")))
def _agreement(spark, sf_dir):
    key = F.concat_ws("/", F.col("station").cast("string"), F.col("date").cast("string"))
    return clearsky.clear_sky_agreement(views.clear_labels(spark, sf_dir).withColumn("date", key),
                                        detected(spark, sf_dir).withColumn("date", key))


# --- estimator -----------------------------------------------------------------

RATIO_X = q6("GHI / nullif(GHI_cs, 0)", "1e9")
RATIO_Y = q6("P_kw_norm / nullif(P_kw_norm_cs, 0)", "1e9")
BASE_OK = "P_kw_norm_cs > 0.2 AND GHI > 50 AND P_kw_norm > 0.05"
FREE = "V <= 253 AND (P_kw_norm >= 1 OR S_norm < 1.001)"
KINDS = {
    "train": f"{BASE_OK} AND P_kw_norm <= P_kw_norm_cs AND {FREE}",
    "split": f"{BASE_OK} AND {FREE}",
    "estimate": f"{BASE_OK} AND P_kw_norm <= P_kw_norm_cs",
    "voltwatt": f"{BASE_OK} AND P_kw_norm <= P_kw_norm_cs AND V > 253",
    "test": f"{BASE_OK} AND (V > 253 OR (P_kw_norm < 1 AND S_norm >= 1.001))",
    "raw_fit": "P_kw_norm_cs > 0.05 AND GHI > 50 AND P_kw_norm > 0.05",
}


def eligible(name: str, kind: str, minutes: int = 5) -> tuple[str, str]:
    return (name, f"SELECT *, {tod('t_stamp', minutes)} AS tod_bin, {RATIO_X} AS x, "
                  f"{RATIO_Y} AS y FROM structured WHERE {KINDS[kind]}")


def split_sql(source: str) -> tuple[str, str]:
    return ("split_", f"""SELECT site_id, actual_day, CASE WHEN rn <= 0.8e0 * total THEN 'train' ELSE 'val' END AS day_type
FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY md5(concat_ws('|', CAST(site_id AS VARCHAR),
        CAST(actual_day AS VARCHAR), '0')), actual_day) AS rn, COUNT(*) OVER (PARTITION BY site_id) AS total
      FROM (SELECT DISTINCT site_id, actual_day FROM {source}))""")


def _varied(f: str, driver: str) -> str:
    return f"CASE WHEN MAX({driver}) > MIN({driver}) THEN {q6(f)} END"


TRAINVAL = ("trainval", "SELECT e.*, day_type FROM el e JOIN split_ USING (site_id, actual_day)")
MODEL = ("model", "SELECT site_id, tod_bin, 1e0 - b AS a, b, n FROM (SELECT site_id, tod_bin, "
                  f"{_varied('regr_slope(y, x)', 'x')} AS b, COUNT(*) AS n FROM trainval WHERE day_type = 'train' GROUP BY ALL)")
FIT = (*SKY, eligible("el", "train"), eligible("free", "split"), split_sql("free"), TRAINVAL, MODEL)


def hand_off(spark, sf_dir) -> HandOff:
    """The stored tables of the chain, shared by the reports of an application until they are released."""
    def make() -> HandOff:
        return HandOff(views.ts(spark, sf_dir), views.meta(spark, sf_dir), lambda: eligible_site(spark, sf_dir),
                       lambda rows: clearsky.structured_data(rows, grid(spark, sf_dir)))

    store = kept(spark, ("chain", sf_dir), make)
    if not store.intact():
        forget(spark, ("chain", sf_dir))
        store = kept(spark, ("chain", sf_dir), make)
    return store


def fitted(spark, sf_dir) -> Fitted:
    return hand_off(spark, sf_dir).chain


@register("eligible_train_rows", with_views("SELECT site_id, t_stamp, tod_bin, x, y FROM el", *SKY, eligible("el", "train"),
                                            views=SOLAR_BASE))
def _eligible_train(spark, sf_dir):
    return estimator.eligible_rows(structured(spark, sf_dir), "train").select("site_id", "t_stamp", "tod_bin", "x", "y")


@register("eligible_test_rows", with_views("SELECT site_id, t_stamp, tod_bin, x, y FROM el", *SKY, eligible("el", "test", 30),
                                           views=SOLAR_BASE))
def _eligible_test(spark, sf_dir):
    return estimator.eligible_rows(structured(spark, sf_dir), "test", 30).select("site_id", "t_stamp", "tod_bin", "x", "y")


@register("dated_bins", with_views(
    "SELECT site_id, t_stamp, time_bucket(INTERVAL 30 MINUTE, t_stamp + INTERVAL 10 HOUR) AS tod_bin FROM structured "
    "WHERE P_kw_norm_cs > 0.05 AND GHI > 50", *SKY, views=SOLAR_BASE))
def _dated_bins(spark, sf_dir):
    return estimator.eligible_rows(structured(spark, sf_dir), "raw_series", 30, dated=True).select(
        "site_id", "t_stamp", "tod_bin")


@register("split_days", with_views("SELECT * FROM split_", *SKY, eligible("el", "split", 30), split_sql("el"), views=SOLAR_BASE))
def _split(spark, sf_dir):
    return estimator.split_days(estimator.eligible_rows(structured(spark, sf_dir), "split", 30))


@register("ghi_norm_model", with_views("SELECT * FROM model", *FIT, views=SOLAR_BASE))
def _model(spark, sf_dir):
    return fitted(spark, sf_dir).model


RAW_MODEL = ("raw_model", f"SELECT site_id, tod_bin, {_varied('regr_intercept(y, GHI)', 'GHI')} AS a, "
                          f"{_varied('regr_slope(y, GHI)', 'GHI')} AS b, COUNT(*) AS n FROM raw GROUP BY ALL")


@register("ghi_model", with_views("SELECT * FROM raw_model", *SKY, eligible("raw", "raw_fit", 30), RAW_MODEL, views=SOLAR_BASE))
def _raw_model(spark, sf_dir):
    return estimator.fit_ghi_model(estimator.eligible_rows(structured(spark, sf_dir), "raw_fit", 30))


def _metric_sql(cond: str, suffix: str, mape_cond: str | None = None) -> str:
    p, e, s = "P_kw_norm", "est", "S_99"
    err = f"CASE WHEN {cond} THEN {p} - {e} END"
    rel = f"CASE WHEN {mape_cond or cond} THEN abs({p} - {e}) / abs({p}) END"
    r = f"corr(CASE WHEN {cond} THEN {p} END, CASE WHEN {cond} THEN {e} END)"
    r2 = q6(f"{r} * {r}")
    varied = " AND ".join(f"MAX({c}) FILTER ({cond}) > MIN({c}) FILTER ({cond})" for c in (p, e))
    mape, rmse = q6(f"AVG({rel}) * 100"), q6(f"sqrt(AVG(({err}) * ({err}))) * {s}")
    mae, bias = q6(f"AVG(abs({err})) * {s}"), q6(f"AVG({err}) * {s}")
    return (f"COUNT(*) FILTER ({cond}) AS n{suffix}, CASE WHEN {varied} THEN {r2} END AS r2{suffix}, "
            f"{mape} AS mape{suffix}, {rmse} AS rmse{suffix}, {mae} AS mae{suffix}, {bias} AS bias{suffix}")


ESTIMATED = ("estd", """SELECT t.*, CASE WHEN P_kw_norm_cs * (a + b * x) >= P_kw_norm THEN P_kw_norm_cs * (a + b * x) END AS est
FROM trainval t JOIN model USING (site_id, tod_bin)""")
COUNTED = "abs(P_kw_norm) > 0.2 AND est IS NOT NULL"
TRAIN, VAL = f"{COUNTED} AND day_type = 'train'", f"{COUNTED} AND day_type = 'val'"
METRICS = ("metrics", f"""SELECT site_id, S_99, {_metric_sql(TRAIN, '_train')}, {_metric_sql(VAL, '_val')}
FROM estd GROUP BY site_id, S_99
HAVING COUNT(*) FILTER (day_type = 'train') > 0 AND COUNT(*) FILTER (day_type = 'val') > 0""")
ACCEPTED = ("accepted", "SELECT site_id FROM metrics WHERE mape_train < 50 AND mape_val < 50")
SCORED = (*FIT, ESTIMATED, METRICS)


MEASURES = ("r2", "mape", "rmse", "mae", "bias")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: quantise(F.col(c)) for c in columns})


@register("model_metrics", with_views("SELECT * FROM metrics", *SCORED, views=SOLAR_BASE))
def _metrics(spark, sf_dir):
    chain = fitted(spark, sf_dir)
    return _rounded(estimator.model_metrics(chain.labelled, chain.model), *[f"{m}_{d}" for m in MEASURES for d in ("train", "val")])


@register("ghi_model_metrics", with_views(f"SELECT site_id, S_99, {_metric_sql('est IS NOT NULL', '', 'abs(P_kw_norm) > 0.2')}, "
                                          "COUNT(*) AS n_rows FROM e2 GROUP BY site_id, S_99",
    *SKY, eligible("raw", "raw_fit", 30), RAW_MODEL,
    ("e2", "SELECT raw.*, P_kw_norm_cs * (a + b * GHI) AS est FROM raw JOIN raw_model USING (site_id, tod_bin)"), views=SOLAR_BASE)
    .replace("COUNT(*) FILTER (est IS NOT NULL) AS n,", "").replace("COUNT(*) AS n_rows", "COUNT(*) AS n"))
def _raw_metrics(spark, sf_dir):
    table = stage(structured(spark, sf_dir), "structured")
    rows = estimator.eligible_rows(table, "raw_fit", 30)
    return _rounded(estimator.model_metrics_unfiltered(rows, estimator.fit_ghi_model(rows)), *MEASURES)


@register("acceptable_sites", with_views("SELECT * FROM accepted", *SCORED, ACCEPTED, views=SOLAR_BASE))
def _acceptable(spark, sf_dir):
    return fitted(spark, sf_dir).accepted_sites()


def _uncurtailed_sql(kind: str) -> str:
    return f"""SELECT t.*, CASE WHEN P_kw_norm_cs * (a + b * x) >= P_kw_norm THEN P_kw_norm_cs * (a + b * x) ELSE P_kw_norm END
  * S_99 AS uncurtailed_P, n AS n_train
FROM (SELECT *, {tod('t_stamp')} AS tod_bin, {RATIO_X} AS x FROM structured WHERE {KINDS[kind]}) t
JOIN model USING (site_id, tod_bin) JOIN accepted USING (site_id)"""


ALL_U = ("all_u", "SELECT site_id, t_stamp, year, month, uncurtailed_P, P_kw_norm * S_99 AS P_kw, x AS GHI, n_train FROM "
                  f"({_uncurtailed_sql('estimate')})")
VW_U = ("vw_u", f"SELECT site_id, t_stamp, uncurtailed_P, V FROM ({_uncurtailed_sql('voltwatt')})")
CHAIN = (*SCORED, ACCEPTED)


def all_uncurtailed(spark, sf_dir) -> DataFrame:
    return hand_off(spark, sf_dir).all_uncurtailed


def voltwatt_uncurtailed(spark, sf_dir) -> DataFrame:
    return hand_off(spark, sf_dir).voltwatt_uncurtailed


@register("all_uncurtailed", with_views("SELECT * FROM all_u", *CHAIN, ALL_U, views=SOLAR_BASE))
def _all_uncurtailed(spark, sf_dir):
    return all_uncurtailed(spark, sf_dir)


@register("voltwatt_uncurtailed", with_views("SELECT * FROM vw_u", *CHAIN, VW_U, views=SOLAR_BASE))
def _voltwatt_uncurtailed(spark, sf_dir):
    return voltwatt_uncurtailed(spark, sf_dir)


TESTED = ("vwg", """SELECT vw.*, vw_u.uncurtailed_P AS u, vw_u.uncurtailed_P > P_limit OR vw_u.uncurtailed_P IS NULL AS tested,
  vw_u.uncurtailed_P > P_limit AND P_kW < P_limit AS lost FROM vw LEFT JOIN vw_u ON vw_u.site_id = vw.site_id AND vw_u.t_stamp = vw.t_stamp""")


@register("voltwatt_conformance_ghi", with_views(f"""
SELECT year, month, day, site_id, {xsum('P_kW')} AS P_kW_sum, {xsum('nc')} AS nonconformance_voltwattghi_sum,
       {q6('SUM(ct)')} AS curtailment_voltwattghi_sum, {npos('nc')} AS nonconformance_voltwattghi_count,
       {npos('ct')} AS curtailment_voltwattghi_count, COUNT(nc) AS total_count
FROM (SELECT *, CASE WHEN tested THEN excess END AS nc, CASE WHEN lost THEN u - P_kW END AS ct FROM vwg)
GROUP BY year, month, day, site_id""", *CHAIN, VW_U, VOLTWATT, TESTED, views=SOLAR_BASE))
def _voltwatt_ghi(spark, sf_dir):
    store = hand_off(spark, sf_dir)
    return conformance.voltwatt_conformance_ghi(store.site.every, store.voltwatt_uncurtailed)


@register("voltwatt_low_irradiance_rows", with_views(
    "SELECT site_id, t_stamp, P_kW, u AS uncurtailed_P, V, ac_capacity_kw, P_limit FROM vwg WHERE u < P_limit AND excess = 0",
    *CHAIN, VW_U, VOLTWATT, TESTED, views=SOLAR_BASE))
def _low_irradiance(spark, sf_dir):
    store = hand_off(spark, sf_dir)
    return conformance.voltwatt_low_irradiance_rows(store.site.every, store.voltwatt_uncurtailed)


@register("voltwatt_curtailment", with_views(f"""
SELECT year, month, day, site_id, {xsum('excess')} AS nonconformance_voltwattghi_sum, {q6('SUM(ct)')} AS curtailment_voltwattghi_sum,
       {npos('excess')} AS nonconformance_voltwattghi_count, {npos('ct')} AS curtailment_voltwattghi_count,
       COUNT(excess) AS total_count
FROM (SELECT *, CASE WHEN lost THEN u - P_kW ELSE 0e0 END AS ct FROM vwg WHERE tested)
GROUP BY year, month, day, site_id""", *CHAIN, VW_U, VOLTWATT, TESTED, views=SOLAR_BASE))
def _voltwatt_curtailment(spark, sf_dir):
    store = hand_off(spark, sf_dir)
    return conformance.voltwatt_curtailment(store.site.every, store.voltwatt_uncurtailed)


@register("voltvar_conformance_curtailment", with_views("SELECT * FROM conf", *CHAIN, ALL_U, BANDS, DEVIATION, (
    "vv", voltvar_rows_sql("uncurtailed_P", "LEFT JOIN all_u ON all_u.site_id = dev.site_id AND all_u.t_stamp = dev.t_stamp")),
    ("conf", voltvar_sql("vv")), views=SOLAR_BASE))
def _voltvar_curtailment(spark, sf_dir):
    store = hand_off(spark, sf_dir)
    return conformance.voltvar_conformance(store.site.every, store.all_uncurtailed)


def _series_sql(source: str, driver: str, where: str = "true") -> str:
    return (f"SELECT site_id, t_stamp, {driver}, P_kw_norm, P_kw_norm_cs * (a + b * {driver}) AS P_kw_norm_est, V, S_norm "
            f"FROM {source} JOIN model USING (site_id, tod_bin) WHERE {where}")


@register("estimate_series_val", with_views(_series_sql("trainval", "x", "day_type = 'val'"), *FIT, views=SOLAR_BASE))
def _series_val(spark, sf_dir):
    chain = fitted(spark, sf_dir)
    return estimator.estimate_series(chain.labelled.where("day_type = 'val'"), chain.model, driver="x")


@register("estimate_series_train", with_views(_series_sql("trainval", "x", "day_type = 'train'"), *FIT, views=SOLAR_BASE))
def _series_train(spark, sf_dir):
    chain = fitted(spark, sf_dir)
    return estimator.estimate_series(chain.labelled.where("day_type = 'train'"), chain.model, driver="x")


@register("estimate_series_test", with_views(_series_sql("tst", "x"), *FIT, eligible("tst", "test"), views=SOLAR_BASE))
def _series_test(spark, sf_dir):
    chain = fitted(spark, sf_dir)
    return estimator.estimate_series(estimator.eligible_rows(chain.structured, "test"), chain.model, driver="x")


@register("estimate_series_accepted_sites", with_views(
    _series_sql("est_rows", "x", "site_id IN (SELECT site_id FROM accepted)"), *CHAIN, eligible("est_rows", "estimate"),
    views=SOLAR_BASE))
def _series_sites(spark, sf_dir):
    chain = fitted(spark, sf_dir)
    rows = estimator.eligible_rows(chain.structured, "estimate")
    return estimator.estimate_series(rows, chain.model, "x", chain.accepted_sites())


@register("estimate_sanity", with_views("""
SELECT site_id, MAX(uncurtailed_P - S_99) AS max_diff, MAX(S_99) AS S_99, MAX(ac_capacity_kw) AS ac_capacity_kw
FROM all_u LEFT JOIN (SELECT DISTINCT site_id, S_99, ac_capacity_kw FROM meta) m USING (site_id)
WHERE uncurtailed_P - S_99 > 0.5 GROUP BY site_id""", *CHAIN, ALL_U, views=SOLAR_BASE))
def _sanity(spark, sf_dir):
    return estimator.estimate_sanity(all_uncurtailed(spark, sf_dir), views.meta(spark, sf_dir))


@register("estimates_below_measured", with_views("SELECT COUNT(*) AS n FROM all_u WHERE uncurtailed_P < P_kw", *CHAIN, ALL_U,
                                                 views=SOLAR_BASE))
def _below(spark, sf_dir):
    return estimator.estimates_below_measured(all_uncurtailed(spark, sf_dir)).agg(F.count("*").alias("n"))


# --- weather -------------------------------------------------------------------

DAILY_TEMP = ("station_temp", """SELECT station_number, day, temp FROM (
  SELECT state_table, station_number, CAST(datetime AS DATE) AS day, MAX(temp) AS temp FROM air_temperature
  WHERE year(datetime) = 2024 AND hour(datetime) BETWEEN 10 AND 14 AND station_number IN (SELECT station_1 FROM site_stations)
  GROUP BY ALL)""")
SITE_TEMP = ("site_temp", """SELECT p.day, max_P_kw, max_GHI, coalesce(a.temp, b.temp, c.temp) AS temp, p.site_id,
  max_GHI * coalesce(a.temp, b.temp, c.temp) AS GHI_T
FROM peaks p JOIN site_stations s ON s.site_id = p.site_id
LEFT JOIN station_day a ON a.station_number = s.station_1 AND a.day = p.day
LEFT JOIN station_day b ON b.station_number = s.station_2 AND b.day = p.day
LEFT JOIN station_day c ON c.station_number = s.station_3 AND c.day = p.day""")
STATION_DAY = ("station_day", "SELECT station_number, day, MAX(temp) AS temp FROM station_temp GROUP BY ALL")


def station_temp(spark, sf_dir) -> DataFrame:
    tables = [views.air_temperature(spark, sf_dir, i) for i in (0, 1)]
    stations = views.site_stations(spark, sf_dir).select(F.col("station_1").alias("station_number"))
    return weather.station_daily_max_temp(tables, stations)


def site_temperatures(spark, sf_dir) -> DataFrame:
    return weather.site_temperature_fallback(peaks(spark, sf_dir), views.site_stations(spark, sf_dir),
                                             station_temp(spark, sf_dir))


@register("station_daily_max_temp", with_views("SELECT * FROM station_temp", DAILY_TEMP, views=("air_temperature", "site_stations")))
def _station_temp(spark, sf_dir):
    return station_temp(spark, sf_dir)


@register("site_temperature_fallback", with_views("SELECT * FROM site_temp", *PEAK_CTES, DAILY_TEMP, STATION_DAY, SITE_TEMP,
                                                  views=(*SOLAR_BASE, "air_temperature", "site_stations")))
def _site_temp(spark, sf_dir):
    return site_temperatures(spark, sf_dir)


PREDICTED = ("predicted", """
SELECT site_id, day, max_P_kw, my + b1 * (GHI_T - m1) + b2 * (max_GHI - m2) AS max_P_kw_pred
FROM site_temp, (SELECT *, coalesce((s1y * s22 - s2y * s12) / nullif(s11 * s22 - s12 * s12, 0), 0) AS b1,
                           coalesce((s2y * s11 - s1y * s12) / nullif(s11 * s22 - s12 * s12, 0), 0) AS b2
  FROM (SELECT AVG(max_P_kw) AS my, AVG(GHI_T) AS m1, AVG(max_GHI) AS m2, var_pop(GHI_T) AS s11, var_pop(max_GHI) AS s22,
               covar_pop(GHI_T, max_GHI) AS s12, covar_pop(GHI_T, max_P_kw) AS s1y, covar_pop(max_GHI, max_P_kw) AS s2y
        FROM site_temp WHERE GHI_T IS NOT NULL)) WHERE GHI_T IS NOT NULL""")
TEMPERATURE_VIEWS = (*SOLAR_BASE, "air_temperature", "site_stations")


@register("peak_power_regression", with_views(
    "SELECT site_id, day, max_P_kw, round(max_P_kw_pred, 5) AS max_P_kw_pred FROM predicted",
    *PEAK_CTES, DAILY_TEMP, STATION_DAY, SITE_TEMP, PREDICTED, views=TEMPERATURE_VIEWS))
def _regression(spark, sf_dir):
    rows = stage(site_temperatures(spark, sf_dir), "site-temperatures")
    return estimator.peak_power_predictions(rows).select(
        "site_id", "day", "max_P_kw", F.round("max_P_kw_pred", 5).alias("max_P_kw_pred"))


@register("peak_power_regression_quality", with_views("""
SELECT COUNT(*) AS n, round(1 - SUM((max_P_kw - max_P_kw_pred) * (max_P_kw - max_P_kw_pred)) / nullif(var_pop(max_P_kw) * COUNT(*), 0), 5) AS r2,
       round(SUM(abs(max_P_kw - max_P_kw_pred)), 4) AS abs_error FROM predicted""",
    *PEAK_CTES, DAILY_TEMP, STATION_DAY, SITE_TEMP, PREDICTED, views=TEMPERATURE_VIEWS))
def _regression_quality(spark, sf_dir):
    rows = stage(site_temperatures(spark, sf_dir), "site-temperatures")
    quality = estimator.regression_quality(estimator.peak_power_predictions(rows))
    return quality.select("n", F.round("r2", 5).alias("r2"), F.round("abs_error", 4).alias("abs_error"))
