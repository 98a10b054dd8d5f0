"""Irradiance-based estimate of uncurtailed power.

The estimate scales clear-sky power by a per-site, per-time-of-day line through the
irradiance ratio. All powers are per unit of S_99 unless a column says kW.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvgrid.functions.exact import quantise
from pvgrid.functions.localtime import dated_bin, tod_bin

SLOPE_DIGITS = 6
RATIO_DIGITS = 9


def _conditions(kind: str) -> Column:
    p, pcs, v, s = (F.col(c) for c in ("P_kw_norm", "P_kw_norm_cs", "V", "S_norm"))
    base = (pcs > 0.2) & (F.col("GHI") > 50) & (p > 0.05)
    unconstrained = (v <= 253) & ((p >= 1) | (s < 1.001))
    kinds = {
        "train": base & (p <= pcs) & unconstrained,
        "split": base & unconstrained,
        "estimate": base & (p <= pcs),
        "voltwatt": base & (p <= pcs) & (v > 253),
        "test": base & ((v > 253) | ((p < 1) & (s >= 1.001))),
        "raw_fit": (pcs > 0.05) & (F.col("GHI") > 50) & (p > 0.05),
        "raw_series": (pcs > 0.05) & (F.col("GHI") > 50),
    }
    if kind not in kinds:
        raise ValueError(f"unknown kind {kind!r}, expected one of {sorted(kinds)}")
    return kinds[kind]


def eligible_rows(structured: DataFrame, kind: str = "train", bin_minutes: int = 5,
                  dated: bool = False) -> DataFrame:
    """Structured rows usable for one purpose, with tod_bin, x and y.

    train / split     fitting and validation, with or without P <= clear-sky P
    estimate          all rows to estimate
    voltwatt          rows above 253 V
    test              rows where curtailment is possible
    raw_fit / raw_series   the older fit on unscaled irradiance

    x is GHI over clear-sky GHI, y is P over clear-sky P; both null for a zero divisor.
    They are kept to nine decimals: equal ratios computed from different rows must stay
    equal, or a bin with one irradiance ratio would be fitted through rounding noise.
    """
    t = F.col("t_stamp")
    return structured.where(_conditions(kind)).withColumns({
        "tod_bin": dated_bin(t, bin_minutes) if dated else tod_bin(t, bin_minutes),
        "x": quantise(F.try_divide(F.col("GHI"), F.col("GHI_cs")), RATIO_DIGITS),
        "y": quantise(F.try_divide(F.col("P_kw_norm"), F.col("P_kw_norm_cs")), RATIO_DIGITS)})


def split_days(rows: DataFrame, fraction: float = 0.8, seed: int = 0) -> DataFrame:
    """Assign each site's days to 'train' or 'val' in a repeatable random order."""
    days = rows.select("site_id", "actual_day").distinct()
    shuffle_key = F.md5(F.concat_ws("|", F.col("site_id").cast("string"),
                                    F.col("actual_day").cast("string"), F.lit(str(seed))))
    site = Window.partitionBy("site_id")
    days = days.withColumns({"rn": F.row_number().over(site.orderBy(shuffle_key, "actual_day")),
                             "total": F.count("*").over(site)})
    return days.select("site_id", "actual_day",
                       F.when(F.col("rn") <= F.lit(fraction) * F.col("total"), "train")
                       .otherwise("val").alias("day_type"))


def _where_varied(coefficient: Column, driver: str) -> Column:
    """Regression coefficient, null where the driver does not vary."""
    return F.when(F.max(driver) > F.min(driver), quantise(coefficient, SLOPE_DIGITS))


def fit_ghi_norm_model(train: DataFrame) -> DataFrame:
    """Line per site and time of day: slope b of y on x, a = 1 - b, n rows.

    The slope is that of the unconstrained fit and is kept to six decimals, so that the
    model does not depend on the order in which rows were combined.
    """
    slope = _where_varied(F.regr_slope("y", "x"), "x")
    return (train.groupBy("site_id", "tod_bin").agg(slope.alias("b"), F.count("*").alias("n"))
            .select("site_id", "tod_bin", (F.lit(1.0) - F.col("b")).alias("a"), "b", "n"))


def fit_ghi_model(rows: DataFrame) -> DataFrame:
    """Line per site and time of day of y on unscaled GHI."""
    return rows.groupBy("site_id", "tod_bin").agg(
        _where_varied(F.regr_intercept("y", "GHI"), "GHI").alias("a"),
        _where_varied(F.regr_slope("y", "GHI"), "GHI").alias("b"),
        F.count("*").alias("n"))


def estimate_uncurtailed(rows: DataFrame, model: DataFrame, driver: str = "x",
                         below: str = "measured") -> DataFrame:
    """Add P_kw_norm_est = P_cs * (a + b * driver) and the model's n as n_train.

    An estimate under the measured power, or a missing one, is replaced by the measured
    power (``below="measured"``), by null (``"null"``) or kept (``"keep"``).
    """
    keyed = model.select("site_id", "tod_bin", "a", "b", F.col("n").alias("n_train"))
    est = F.col("P_kw_norm_cs") * (F.col("a") + F.col("b") * F.col(driver))
    p = F.col("P_kw_norm")
    if below == "measured":
        value = F.when(est >= p, est).otherwise(p)
    elif below == "null":
        value = F.when(est >= p, est)
    elif below == "keep":
        value = est
    else:
        raise ValueError(f"unknown treatment {below!r}")
    return rows.join(keyed, ["site_id", "tod_bin"]).withColumn("P_kw_norm_est", value)


def _r_squared(cond: Column, p: Column, est: Column) -> Column:
    """Squared correlation over the rows meeting the condition, null without variation."""
    p, est = F.when(cond, p), F.when(cond, est)
    varied = (F.max(p) > F.min(p)) & (F.max(est) > F.min(est))
    covariance = F.covar_pop(p, est)
    return F.when(varied, F.try_divide(covariance * covariance, F.var_pop(p) * F.var_pop(est)))


def _error_metrics(cond: Column, suffix: str) -> list[Column]:
    p, est, s = F.col("P_kw_norm"), F.col("P_kw_norm_est"), F.col("S_99")
    err = F.when(cond, p - est)
    return [
        F.count_if(cond).alias(f"n{suffix}"),
        _r_squared(cond, p, est).alias(f"r2{suffix}"),
        (F.avg(F.try_divide(F.abs(err), F.abs(p))) * 100).alias(f"mape{suffix}"),
        (F.sqrt(F.avg(err * err)) * F.first(s)).alias(f"rmse{suffix}"),
        (F.avg(F.abs(err)) * F.first(s)).alias(f"mae{suffix}"),
        (F.avg(err) * F.first(s)).alias(f"bias{suffix}"),
    ]


def model_metrics(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Fit quality per site on training and validation days, in one aggregation.

    ``rows`` carry day_type. Only rows above 0.2 with an estimate at or above the
    measured power enter, so the error measures are one-sided. Sites need rows of both
    kinds.
    """
    est = estimate_uncurtailed(rows, model, below="null")
    counted = (F.abs(F.col("P_kw_norm")) > 0.2) & F.col("P_kw_norm_est").isNotNull()
    train, val = F.col("day_type") == "train", F.col("day_type") == "val"
    out = est.groupBy("site_id", "S_99").agg(
        F.count_if(train).alias("_train"), F.count_if(val).alias("_val"),
        *_error_metrics(counted & train, "_train"), *_error_metrics(counted & val, "_val"))
    return out.where((F.col("_train") > 0) & (F.col("_val") > 0)).drop("_train", "_val")


def model_metrics_unfiltered(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Fit quality per site of the older model: all rows, MAPE above 0.2 only."""
    est = estimate_uncurtailed(rows, model, driver="GHI", below="keep")
    p, e, s = F.col("P_kw_norm"), F.col("P_kw_norm_est"), F.col("S_99")
    return est.groupBy("site_id", "S_99").agg(
        F.count("*").alias("n"), _r_squared(e.isNotNull(), p, e).alias("r2"),
        (F.avg(F.when(F.abs(p) > 0.2, F.try_divide(F.abs(p - e), F.abs(p)))) * 100).alias("mape"),
        (F.sqrt(F.avg((p - e) * (p - e))) * F.first(s)).alias("rmse"),
        (F.avg(F.abs(p - e)) * F.first(s)).alias("mae"),
        (F.avg(p - e) * F.first(s)).alias("bias"))


def acceptable_sites(metrics: DataFrame, limit: float = 50) -> DataFrame:
    """Sites whose percentage error is below the limit on both kinds of days."""
    return metrics.where((F.col("mape_train") < limit) & (F.col("mape_val") < limit)).select("site_id")


def _estimated(structured: DataFrame, model: DataFrame, sites: DataFrame | None, kind: str) -> DataFrame:
    rows = eligible_rows(structured, kind)
    if sites is not None:
        rows = rows.join(sites.select("site_id").distinct(), "site_id", "left_semi")
    est = estimate_uncurtailed(rows, model)
    return est.where(F.col("P_kw_norm_est").isNotNull()).withColumn(
        "uncurtailed_P", F.col("P_kw_norm_est") * F.col("S_99"))


def all_uncurtailed(structured: DataFrame, model: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Uncurtailed power of every eligible row; GHI holds the irradiance ratio."""
    t = F.col("t_stamp")
    return _estimated(structured, model, sites, "estimate").select(
        "site_id", "t_stamp", F.year(t).alias("year"), F.month(t).alias("month"), "uncurtailed_P",
        (F.col("P_kw_norm") * F.col("S_99")).alias("P_kw"), F.col("x").alias("GHI"), "n_train")


def voltwatt_uncurtailed(structured: DataFrame, model: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Uncurtailed power of the rows above 253 V."""
    return _estimated(structured, model, sites, "voltwatt").select("site_id", "t_stamp", "uncurtailed_P", "V")


def estimate_series(rows: DataFrame, model: DataFrame, driver: str = "GHI",
                    sites: DataFrame | None = None) -> DataFrame:
    """Measured next to estimated power for the given rows, unclipped."""
    if sites is not None:
        rows = rows.join(sites.select("site_id").distinct(), "site_id", "left_semi")
    return estimate_uncurtailed(rows, model, driver=driver, below="keep").select(
        "site_id", "t_stamp", F.col(driver), "P_kw_norm", "P_kw_norm_est", "V", "S_norm")


def estimate_sanity(uncurtailed: DataFrame, meta: DataFrame, margin: float = 0.5) -> DataFrame:
    """Sites whose estimate exceeds S_99 by more than the margin, worst first."""
    dim = meta.select("site_id", "S_99", "ac_capacity_kw").distinct()
    over = uncurtailed.select("site_id", "uncurtailed_P").join(dim, "site_id", "left")
    diff = F.col("uncurtailed_P") - F.col("S_99")
    return (over.where(diff > margin).groupBy("site_id")
            .agg(F.max(diff).alias("max_diff"), F.max("S_99").alias("S_99"),
                 F.max("ac_capacity_kw").alias("ac_capacity_kw"))
            .orderBy(F.col("max_diff").desc(), "site_id"))


def estimates_below_measured(uncurtailed: DataFrame) -> DataFrame:
    """Rows whose estimate is under the measured power; none are expected."""
    return uncurtailed.where(F.col("uncurtailed_P") < F.col("P_kw"))


#: Below this share of the product of variances the two drivers count as one line.
COLLINEAR = 1e-12


def _usable(peaks: DataFrame) -> DataFrame:
    """Rows with all three values; NaN counts as missing."""
    present = [F.col(c).isNotNull() & ~F.isnan(c) for c in ("max_P_kw", "GHI_T", "max_GHI")]
    return peaks.where(present[0] & present[1] & present[2])


def peak_power_regression(peaks: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Least squares of max_P_kw on GHI_T and max_GHI: n, intercept, b_temperature, b_ghi, per group or overall.

    One aggregation of centred moments, which tasks merge, and the normal equations solved in the row of each group, so
    a fit per site costs no more than one for all. Drivers that don't vary apart from each other share one line: the
    first that varies has a slope, the other's is 0.
    """
    y, t, g = (F.col(c).cast("double") for c in ("max_P_kw", "GHI_T", "max_GHI"))
    moments = {"n": F.count("*"), "_y": F.avg(y), "_t": F.avg(t), "_g": F.avg(g), "_tt": F.var_pop(t), "_gg": F.var_pop(g),
               "_tg": F.covar_pop(t, g), "_ty": F.covar_pop(t, y), "_gy": F.covar_pop(g, y)}
    rows = _usable(peaks).groupBy(*groups).agg(*[e.alias(n) for n, e in moments.items()]).where("n > 0")
    tt, gg, tg, ty, gy = (F.col(c) for c in ("_tt", "_gg", "_tg", "_ty", "_gy"))
    det = tt * gg - tg * tg
    regular = det > F.lit(COLLINEAR) * tt * gg
    slope_t = F.when(regular, F.try_divide(ty * gg - gy * tg, det)).when(tt > 0, F.try_divide(ty, tt)).otherwise(F.lit(0.0))
    slope_g = F.when(regular, F.try_divide(gy * tt - ty * tg, det)).when((tt <= 0) & (gg > 0), F.try_divide(gy, gg)).otherwise(F.lit(0.0))
    rows = rows.withColumns({"b_temperature": slope_t, "b_ghi": slope_g})
    intercept = F.col("_y") - F.col("b_temperature") * F.col("_t") - F.col("b_ghi") * F.col("_g")
    return rows.select(*groups, "n", intercept.alias("intercept"), "b_temperature", "b_ghi")


def peak_power_predictions(peaks: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Site-days with the peak power predicted from irradiance and temperature, by the fit of their group."""
    fits = peak_power_regression(peaks, groups).drop("n")
    rows = _usable(peaks)
    # the fit of all rows is one row
    joined = rows.join(fits, list(groups)) if groups else rows.withColumn("_fit", F.lit(1)).join(
        F.broadcast(fits.withColumn("_fit", F.lit(1))), "_fit").drop("_fit")
    predicted = F.col("intercept") + F.col("b_temperature") * F.col("GHI_T") + F.col("b_ghi") * F.col("max_GHI")
    return joined.withColumn("max_P_kw_pred", predicted).drop("intercept", "b_temperature", "b_ghi")


def regression_quality(predicted: DataFrame) -> DataFrame:
    """R2 and summed absolute error of the predictions."""
    y, e = F.col("max_P_kw"), F.col("max_P_kw_pred")
    sse, n = F.sum((y - e) * (y - e)), F.count("*")
    return predicted.agg(
        n.alias("n"), (F.lit(1.0) - F.try_divide(sse, F.var_pop(y) * n)).alias("r2"),
        F.sum(F.abs(y - e)).alias("abs_error"))
