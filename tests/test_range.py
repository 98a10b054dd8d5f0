"""Range of exact sums, quantiles of short frames, previous rows, staging."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pvgrid.functions.exact import exact_avg, exact_sum, wide_sum
from pvgrid.functions.previous import with_previous
from pvgrid.functions.quantiles import frame_quantile
from pvgrid.operators import edp, estimator, quality
from pvgrid.plans.chain import fit
from pvgrid.session import release, stage


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", before)


def doubles(spark, *values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def test_addends_beyond_the_range_raise(spark, ansi):
    with pytest.raises(Exception, match="added exactly"):
        doubles(spark, 1e14).agg(exact_sum(F.col("x"))).collect()


def test_infinite_addends_are_missing(spark, ansi):
    row = doubles(spark, float("inf"), float("-inf"), float("nan"), 3).agg(exact_sum(F.col("x")), exact_avg(F.col("x"))).first()
    assert tuple(row) == (3.0, 3.0)


def test_sums_beyond_the_range_are_null_or_wide(spark, ansi):
    row = doubles(spark, 9e12, 9e12).agg(exact_sum(F.col("x")), exact_avg(F.col("x")), wide_sum(F.col("x"))).first()
    assert tuple(row) == (None, None, 1.8e13)


def test_frame_quantile_equals_the_sketch(spark):
    rng = random.Random(4)
    rows = [(k % 3, k, None if rng.random() < 0.3 else rng.random()) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, t int, x double")
    w = Window.partitionBy("g").orderBy("t")
    both = df.select(frame_quantile(F.col("x"), w).alias("a"),
                     F.percentile_approx("x", F.lit(0.6), F.lit(10000)).over(w.rowsBetween(-3, 3)).alias("b"))
    assert both.where("NOT (a <=> b)").count() == 0


def test_previous_row_over_a_million_times_of_one_key(spark):
    times = spark.range(1_000_000).select(F.lit(7).alias("k"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("t"), "id")
    got = with_previous(times, ("k",), "t", {"before": "id"})
    assert got.columns == ["k", "t", "id", "before"]
    assert got.where("id > 0 AND NOT (before <=> id - 1)").count() == 0
    assert got.where("id = 0 AND before IS NULL").count() == 1
    # a window never holds more than a day
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_day" in plan and plan.count("windowspecdefinition(k") <= plan.count("windowspecdefinition(k#") + 1
    assert quality.sampling_interval(times, "k", "t").first().min_diff_seconds == 60


def test_missing_voltage_of_the_second_data_set(spark):
    readings = spark.createDataFrame(
        [("S1", "pv_site_net", "2024-01-01 12:00:00", 500.0, 0.0, 1.0, None)],
        "edp_site_id string, circuit_label string, t string, real_energy double, reactive_energy double, current_avg double, "
        "voltage_avg double").withColumn("datetime", F.col("t").cast("timestamp"))
    ratings = spark.createDataFrame([("S1", 5000, 10.0)], "edp_site_id string, postcode int, Srated double")
    assert edp.process_edp(readings, ratings).first().Q_noncomp is None
    row = edp.process_edp(readings, ratings, missing_voltage="absorb").first()
    assert (row.Q_voltvar, row.Q_noncomp) == (-6.0, 5.5)


def test_days_without_training_rows_take_part_in_the_split(spark):
    """A day whose rows all exceed clear-sky power counts for the split, though it trains nothing."""
    schema = ("site_id bigint, t_stamp timestamp, actual_day date, V double, P_kw_norm double, P_kw_norm_cs double, "
              "S_norm double, S_99 double, GHI double, GHI_cs double")
    rows = [(1, f"2024-01-{d:02} 00:00:00", 240.0, 0.5 + 0.01 * d if d % 2 else 0.95, 0.9, 0.95, 5.0, 400.0 + 10 * d, 800.0)
            for d in range(1, 21)]
    df = spark.createDataFrame(rows, "site_id bigint, t string, V double, P_kw_norm double, P_kw_norm_cs double, S_norm double, "
                                     "S_99 double, GHI double, GHI_cs double")
    df = df.withColumns({"t_stamp": F.col("t").cast("timestamp"), "actual_day": F.to_date("t")}).select(*[c.split()[0] for c in schema.split(", ")])
    chain = fit(df)
    days = {r.actual_day: r.day_type for r in estimator.split_days(estimator.eligible_rows(df, "split")).collect()}
    assert len(days) == 20
    got = {r.actual_day: r.day_type for r in chain.labelled.collect()}
    assert len(got) == 10 and all(days[d] == kind for d, kind in got.items())


def test_release_deletes_what_was_staged(spark):
    release(spark)
    kept = stage(spark.range(5), "gone")
    assert kept.count() == 5 and release(spark) == 1
    with pytest.raises(Exception):
        kept.collect()
