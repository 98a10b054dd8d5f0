from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pvgrid.operators import conformance, estimator, weather

T0 = dt.datetime(2024, 1, 1, 0, 0)
ROW = ("site_id bigint, t_stamp timestamp, actual_day date, V double, P_kw_norm double, P_kw_norm_cs double, "
       "S_norm double, S_99 double, GHI double, GHI_cs double")


def rows(spark, n_days=10, b=0.8, noise=0.0):
    out = []
    for d in range(n_days):
        t = T0 + dt.timedelta(days=d)
        x = 0.5 + 0.04 * d
        y = 1 - b + b * x + (noise if d % 2 else -noise)
        out.append((1, t, t.date(), 240.0, 0.9 * y, 0.9, 0.95, 5.0, 800.0 * x, 800.0))
    return spark.createDataFrame(out, ROW)


def test_split_is_repeatable_and_honours_the_fraction(spark):
    df = rows(spark, 10)
    split = {r.actual_day: r.day_type for r in estimator.split_days(df).collect()}
    again = {r.actual_day: r.day_type for r in estimator.split_days(df.repartition(7)).collect()}
    assert split == again and list(split.values()).count("train") == 8
    other = {r.actual_day: r.day_type for r in estimator.split_days(df, seed=1).collect()}
    assert other != split


def test_model_recovers_the_line_and_ignores_constant_ratios(spark):
    model = estimator.fit_ghi_norm_model(estimator.eligible_rows(rows(spark))).first()
    assert (model.tod_bin, model.n) == (600, 10)
    assert model.b == pytest.approx(0.8, abs=1e-6) and model.a == pytest.approx(0.2, abs=1e-6)
    flat = rows(spark).withColumn("GHI", F.lit(400.0))
    assert estimator.fit_ghi_norm_model(estimator.eligible_rows(flat)).first().b is None


def test_estimates_never_fall_below_measured_power(spark):
    data = estimator.eligible_rows(rows(spark, noise=0.05), "estimate")
    model = spark.createDataFrame([(1, 600, 0.2, 0.8, 10)], "site_id bigint, tod_bin int, a double, b double, n bigint")
    kept = estimator.estimate_uncurtailed(data, model, below="measured")
    assert kept.where("P_kw_norm_est < P_kw_norm").count() == 0
    nulls = estimator.estimate_uncurtailed(data, model, below="null")
    assert nulls.where("P_kw_norm_est IS NULL").count() == 5
    raw = estimator.estimate_uncurtailed(data, model, below="keep")
    assert raw.where("P_kw_norm_est < P_kw_norm").count() == 5
    with pytest.raises(ValueError):
        estimator.estimate_uncurtailed(data, model, below="other")


def test_eligibility_kinds(spark):
    base = (1, T0, T0.date())
    data = [(*base, 240.0, 0.5, 0.6, 0.9, 5.0, 500.0, 800.0),    # train, estimate
            (*base, 255.0, 0.5, 0.6, 0.9, 5.0, 500.0, 800.0),    # voltwatt, estimate, test
            (*base, 240.0, 0.7, 0.6, 0.9, 5.0, 500.0, 800.0),    # above the profile: split only
            (*base, 240.0, 0.5, 0.6, 1.01, 5.0, 500.0, 800.0),   # at its rating: test, estimate
            (*base, 240.0, 0.5, 0.15, 0.9, 5.0, 500.0, 800.0),   # weak profile: raw_fit only
            (*base, 240.0, 0.5, 0.6, 0.9, 5.0, 50.0, 800.0)]     # dark
    df = spark.createDataFrame(data, ROW)
    counts = {k: estimator.eligible_rows(df, k).count() for k in
              ("train", "split", "estimate", "voltwatt", "test", "raw_fit")}
    assert counts == {"train": 1, "split": 2, "estimate": 3, "voltwatt": 1, "test": 2, "raw_fit": 5}
    with pytest.raises(ValueError):
        estimator.eligible_rows(df, "other")


def test_metrics_are_one_sided(spark):
    data = estimator.eligible_rows(rows(spark, noise=0.05)).withColumn(
        "day_type", F.when(F.dayofmonth("actual_day") <= 6, "train").otherwise("val"))
    model = spark.createDataFrame([(1, 600, 0.2, 0.8, 10)], "site_id bigint, tod_bin int, a double, b double, n bigint")
    m = estimator.model_metrics(data, model).first()
    assert (m.n_train, m.n_val) == (3, 2)
    assert m.bias_train == pytest.approx(-0.9 * 0.05 * 5) and m.mae_train == pytest.approx(0.9 * 0.05 * 5)
    assert estimator.acceptable_sites(spark.createDataFrame([(1, 10.0, 49.0), (2, 10.0, 50.0), (3, None, 1.0)],
        "site_id bigint, mape_train double, mape_val double")).collect() == [(1,)]


def site(spark):
    data = [(1, T0 + dt.timedelta(minutes=5 * i), p, 0.0, v, 5.0, 4.0) for i, (p, v) in enumerate(
        [(4.0, 256.5), (4.0, 256.5), (2.0, 256.5), (2.0, 256.5), (4.0, 250.0)])]
    return spark.createDataFrame(data, "site_id bigint, t_stamp timestamp, P_kW double, Q_kvar double, V double, "
                                       "ac_capacity_kw double, S_99 double")


def uncurtailed(spark):
    """Limit is 3.2 kW at 256.5 V: no estimate, low, high, low."""
    t = [T0 + dt.timedelta(minutes=5 * i) for i in range(4)]
    return spark.createDataFrame([(1, t[1], 3.0), (1, t[2], 4.5), (1, t[3], 3.0)],
                                 "site_id bigint, t_stamp timestamp, uncurtailed_P double")


def test_untested_rows_do_not_count(spark):
    r = conformance.voltwatt_conformance_ghi(site(spark), uncurtailed(spark)).first()
    assert (r.total_count, r.nonconformance_voltwattghi_count, r.curtailment_voltwattghi_count) == (2, 1, 1)
    assert r.nonconformance_voltwattghi_sum == pytest.approx(0.8) and r.curtailment_voltwattghi_sum == pytest.approx(2.5)
    c = conformance.voltwatt_curtailment(site(spark), uncurtailed(spark)).first()
    assert (c.total_count, c.curtailment_voltwattghi_sum) == (2, 2.5)
    low = conformance.voltwatt_low_irradiance_rows(site(spark), uncurtailed(spark)).collect()
    assert [x.P_kW for x in low] == [2.0]


def test_classes_are_exclusive_and_add_up(spark):
    data = [(1, T0 + dt.timedelta(minutes=5 * i), 2.0, q / 10, 200.0 + v, 5.0, 4.0)
            for i, (q, v) in enumerate((q, v) for q in range(-40, 41, 5) for v in range(0, 65, 4))]
    df = spark.createDataFrame(data, "site_id bigint, t_stamp timestamp, P_kW double, Q_kvar double, V double, "
                                     "ac_capacity_kw double, S_99 double")
    dev = conformance.voltvar_deviation(df)
    nonzero = sum((F.col(c) > 0).cast("int") for c in conformance.VOLTVAR_CLASSES)
    assert dev.where(nonzero > 1).count() == 0
    assert dev.where((F.col("deviation") > 0) != F.col("outside")).count() == 0
    assert all(dev.where(F.col(c) > 0).count() > 0 for c in conformance.VOLTVAR_CLASSES)
    relaxed = conformance.voltvar_deviation(df, surplus_is_nonconformant=False)
    assert relaxed.where("Q_major_surplus > 0").count() == 0


def test_first_known_station_temperature(spark):
    days = spark.createDataFrame([(s, T0.date(), 4.0, 900.0) for s in (1, 2, 3)],
                                 "site_id bigint, day date, max_P_kw double, max_GHI double")
    near = spark.createDataFrame([(1, 7, 8, 9), (2, 6, 8, 9), (3, 4, 5, 6)],
                                 "site_id bigint, station_1 bigint, station_2 bigint, station_3 bigint")
    temps = spark.createDataFrame([(7, T0.date(), 20.0), (8, T0.date(), 30.0)], "station_number bigint, day date, temp double")
    got = {r.site_id: (r.temp, r.GHI_T) for r in weather.site_temperature_fallback(days, near, temps).collect()}
    assert got == {1: (20.0, 18000.0), 2: (30.0, 27000.0), 3: (None, None)}


def test_peak_power_regression(spark):
    data = [(1, float(g * t), float(g), 1.0 + 2e-5 * g * t + 3e-3 * g) for g in range(300, 900, 50) for t in (10, 20, 31)]
    df = spark.createDataFrame(data, "site_id int, GHI_T double, max_GHI double, max_P_kw double")
    quality = estimator.regression_quality(estimator.peak_power_predictions(df)).first()
    assert quality.n == len(data) and quality.r2 == pytest.approx(1.0) and quality.abs_error == pytest.approx(0, abs=1e-6)


def test_regression_equals_the_library_fit_overall_and_by_group(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = random.Random(3)
    rows = [(k % 4, 20 + rng.random() * 15, 300 + rng.random() * 700, 0.0) for k in range(400)]
    rows = [(s, t, g, 0.004 * g - 0.03 * t + s + rng.gauss(0, 0.2)) for s, t, g, _ in rows]
    df = spark.createDataFrame([*rows, (1, None, 500.0, 1.0), (1, 20.0, 500.0, None), (1, float("nan"), 5.0, 1.0)],
                               "site_id int, GHI_T double, max_GHI double, max_P_kw double")

    def library(part):
        part = VectorAssembler(inputCols=["GHI_T", "max_GHI"], outputCol="f").transform(part.where("NOT isnan(GHI_T)").dropna())
        model = LinearRegression(labelCol="max_P_kw", featuresCol="f", solver="normal").fit(part)
        return [model.intercept, *model.coefficients]

    one = estimator.peak_power_regression(df).first()
    assert list(one) == [400, *[pytest.approx(v, rel=1e-9) for v in library(df)]]
    for r in estimator.peak_power_regression(df, ("site_id",)).collect():
        assert [r.intercept, r.b_temperature, r.b_ghi] == [pytest.approx(v, rel=1e-8) for v in library(df.where(F.col("site_id") == r.site_id))]
    assert estimator.peak_power_predictions(df, ("site_id",)).count() == 400


def test_regression_without_variation(spark):
    columns = "GHI_T double, max_GHI double, max_P_kw double"
    line = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 5.0), (3.0, 6.0, 7.0)], columns)
    assert [round(v, 9) for v in estimator.peak_power_regression(line).first()] == [3, 1.0, 2.0, 0.0]
    level = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 4.0, 5.0)], columns)
    assert [round(v, 9) for v in estimator.peak_power_regression(level).first()] == [2, 1.0, 0.0, 1.0]
    point = spark.createDataFrame([(1.0, 2.0, 3.0)], columns)
    assert list(estimator.peak_power_regression(point).first()) == [1, 3.0, 0.0, 0.0]
    assert estimator.peak_power_regression(point.where("false")).collect() == []
