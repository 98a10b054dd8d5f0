"""Operators over consecutive samples: anti-islanding, sustained operation, flexible export.

Windows are bounded whatever the data size: after site aggregation a window group is
one site in one calendar month (or one local day), at most one row per time stamp.
Lags start afresh each month, which is also how a month-by-month run behaves, or take the last rows of earlier
months from a summary of a few rows per month.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvgrid.functions.curves import TOLERANCE
from pvgrid.functions.exact import count_positive, exact_sum
from pvgrid.functions.localtime import calendar, day_night, local_day
from pvgrid.functions.previous import with_lagged

ANTI_ISLANDING_THRESHOLDS = (260, 261, 262, 263, 264, 265)
SUSTAINED_THRESHOLDS = (253, 254, 255, 256, 257, 258)


def with_lags(site: DataFrame, lags: int = 3, reset_monthly: bool = True) -> DataFrame:
    """Add prev_V_k and prev_P_k for the last ``lags`` samples of the site, of the same month or of any."""
    t = F.col("t_stamp")
    if not reset_monthly and lags:
        rows = with_lagged(site, ("site_id",), ("_month", F.date_trunc("month", t)), ("t_stamp", "ac_capacity_kw"), ("V", "P_kW"), lags)
        before = {k: F.get("_before", F.lit(k - 1)) for k in range(1, lags + 1)}
        return rows.withColumns({f"prev_{n}_{k}": e[c] for k, e in before.items() for n, c in (("V", "V"), ("P", "P_kW"))}).drop("_before")
    w = Window.partitionBy("site_id", F.year(t), F.month(t)).orderBy("t_stamp", "ac_capacity_kw")
    columns = {}
    for k in range(1, lags + 1):
        columns[f"prev_V_{k}"] = F.lag("V", k).over(w)
        columns[f"prev_P_{k}"] = F.lag("P_kW", k).over(w)
    return site.withColumns(columns)


def _any_power(*names: str) -> Column:
    floor = F.lit(TOLERANCE) * F.col("ac_capacity_kw")
    return reduce(lambda a, b: a | b, [F.col(n) > floor for n in names])


def _at_least(thr: Column, *names: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n) >= thr for n in names])


# Each rule: (samples looked back, condition as a function of the voltage threshold).
RULES: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "two_sample": (2, lambda thr: _at_least(thr, "V", "prev_V_1")
                   & _any_power("P_kW", "prev_P_1", "prev_P_2")),
    "one_sample_or_power": (1, lambda thr: _at_least(thr, "V")
                            & (_at_least(thr, "prev_V_1") | _any_power("prev_P_1", "P_kW"))),
    "voltage_only": (0, lambda thr: _at_least(thr, "V")),
    "sustained": (2, lambda thr: _at_least(thr, "V", "prev_V_1")
                  & (_at_least(thr, "prev_V_2") | _any_power("prev_P_2", "P_kW"))),
    "sustained_3w": (3, lambda thr: _at_least(thr, "V", "prev_V_1", "prev_V_2")
                     & _any_power("P_kW", "prev_P_1", "prev_P_2", "prev_P_3")),
}


def threshold_sweep(site: DataFrame, thresholds: Sequence[float], rule: str, prefix: str = "nonconformance",
                    day_only: bool = False, reset_monthly: bool = True) -> DataFrame:
    """Rows meeting ``rule`` per voltage threshold, summed by site and day.

    All thresholds share one scan, one window and one aggregation: a row is repeated
    only for the thresholds its voltage reaches, and combined again before the shuffle.
    """
    lags, condition = RULES[rule]
    rows = with_lags(site, lags, reset_monthly) if lags else site
    rows = rows.where(F.col("V") >= float(min(thresholds)))
    rows = rows.withColumn("v_threshold", F.explode(F.array(*[F.lit(float(v)) for v in thresholds])))
    rows = rows.where(condition(F.col("v_threshold")))
    floor = F.lit(TOLERANCE) * F.col("ac_capacity_kw")
    rows = rows.withColumns({
        "excess": F.when(F.col("P_kW") >= floor, F.col("P_kW") - floor).otherwise(F.lit(0.0)),
        "day_night": day_night(F.col("t_stamp")),
        **calendar(F.col("t_stamp"))})
    if day_only:
        rows = rows.where(F.col("day_night") == "day")
    return rows.groupBy("year", "month", "day", "day_night", "site_id", "v_threshold").agg(
        exact_sum(F.col("excess")).alias(f"{prefix}_sum"),
        count_positive(F.col("excess")).alias(f"{prefix}_count"),
        F.count("excess").alias("total_count"))


def anti_islanding_conformance(site: DataFrame, thresholds: Sequence[float] = ANTI_ISLANDING_THRESHOLDS,
                               rule: str = "two_sample", reset_monthly: bool = True) -> DataFrame:
    """Still producing after the voltage stayed at the trip level."""
    return threshold_sweep(site, thresholds, rule, "nonconformance_antiisland",
                           reset_monthly=reset_monthly)


def sustained_operation(site: DataFrame, thresholds: Sequence[float] = SUSTAINED_THRESHOLDS,
                        reset_monthly: bool = True) -> DataFrame:
    """Daytime production while two samples stay above the sustained-operation level."""
    return threshold_sweep(site, thresholds, "sustained", "nonconformance_sust_op", day_only=True,
                           reset_monthly=reset_monthly)


def sustained_operation_3w(site: DataFrame, thresholds: Sequence[float] = SUSTAINED_THRESHOLDS,
                           reset_monthly: bool = True) -> DataFrame:
    """The same with three samples above the level."""
    return threshold_sweep(site, thresholds, "sustained_3w", "nonconformance_sust_op_3w", day_only=True,
                           reset_monthly=reset_monthly)


def sites_by_threshold(conformance: DataFrame) -> DataFrame:
    """Number of sites and of site-days per voltage threshold."""
    return conformance.groupBy("v_threshold").agg(
        F.countDistinct("site_id").alias("n_sites"), F.count("*").alias("n_rows"))


def _plateau_rows(site: DataFrame, strict_upper: bool) -> DataFrame:
    """Rows of five consecutive samples of a local day with their power spread."""
    w = Window.partitionBy("site_id", "day").orderBy("t_stamp")
    day = Window.partitionBy("site_id", "day")
    rows = site.withColumn("day", local_day(F.col("t_stamp")))
    rows = rows.withColumns({
        "max_P_kW": F.max("P_kW").over(day),
        **{f"prev_P_{k}": F.lag("P_kW", k).over(w) for k in range(1, 5)}})
    p, s = F.col("P_kW"), F.col("ac_capacity_kw")
    last5 = [p] + [F.col(f"prev_P_{k}") for k in range(1, 5)]
    ceiling = F.lit(0.75) * F.col("max_P_kW")
    rows = rows.where((p >= F.lit(0.2) * s) & ((p < ceiling) if strict_upper else (p <= ceiling)) & (s >= 5))
    rows = rows.where(reduce(lambda a, b: a & b, [c.isNotNull() for c in last5[1:]]))
    return rows.withColumn("spread", F.greatest(*last5) - F.least(*last5))


def flex_export_sites(site: DataFrame, tolerance_kw: float = 0.004) -> DataFrame:
    """Site-days with a flat stretch of five samples well below the day's peak."""
    rows = _plateau_rows(site, strict_upper=False)
    return (rows.groupBy("site_id", "day").agg(F.min("spread").alias("min_spread"))
            .where(F.col("min_spread") < tolerance_kw).select("site_id", "day"))


def flex_export_rows(site: DataFrame, tolerance_kw: float = 0.004) -> DataFrame:
    """The single rows that end such a flat stretch."""
    rows = _plateau_rows(site, strict_upper=True)
    return rows.where(F.col("spread") < tolerance_kw).select("site_id", "t_stamp", "P_kW")


def flag_flex_export(meta: DataFrame, sites: DataFrame) -> DataFrame:
    """Set flex_export_detected on every circuit, true for the listed sites."""
    flagged = sites.select("site_id").distinct().withColumn("_flex", F.lit(True))
    return (meta.drop("flex_export_detected").join(flagged, "site_id", "left")
            .withColumn("flex_export_detected", F.coalesce(F.col("_flex"), F.lit(False)))
            .drop("_flex"))
