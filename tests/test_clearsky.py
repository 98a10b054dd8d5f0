from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pvgrid.functions.quantiles import frame_quantile
from pvgrid.operators import clearsky

D = dt.date
CELL_DAY = "latitude double, longitude double, day date"


def test_nearest_clear_day_prefers_the_later_on_a_tie(spark):
    days = spark.createDataFrame([(-10.0, 120.0, D(2024, 1, d)) for d in (1, 5, 6, 7, 20)]
                                 + [(-11.0, 121.0, D(2024, 1, 5))], CELL_DAY)
    clear = spark.createDataFrame([(-10.0, 120.0, D(2024, 1, d)) for d in (4, 8)], CELL_DAY)
    got = {(r.latitude, r.actual_day.day): r.cs_day.day for r in
           clearsky.nearest_clear_sky_day(days, clear).collect()}
    assert got == {(-10.0, 1): 4, (-10.0, 5): 4, (-10.0, 6): 8, (-10.0, 7): 8, (-10.0, 20): 8}


def test_nearest_clear_day_matches_brute_force(spark):
    rng = random.Random(2)
    start = D(2024, 1, 1)
    cells = [(-float(c), float(c)) for c in range(5)]
    days = [(*c, start + dt.timedelta(days=i)) for c in cells for i in range(200) if rng.random() < 0.5]
    clear = [(*c, start + dt.timedelta(days=i)) for c in cells for i in range(200) if rng.random() < 0.05]
    got = {(r.latitude, r.actual_day): r.cs_day for r in clearsky.nearest_clear_sky_day(
        spark.createDataFrame(days, CELL_DAY), spark.createDataFrame(clear, CELL_DAY)).collect()}
    want = {}
    for la, lo, day in days:
        options = [c for a, b, c in clear if (a, b) == (la, lo)]
        if options:
            want[(la, day)] = min(options, key=lambda c: (abs((c - day).days), (day - c).days))
    assert got == want


def test_segments_start_after_gaps_over_thirty_minutes(spark):
    t0 = dt.datetime(2024, 1, 1, 22, 0)
    minutes = (0, 5, 35, 66, 71, 24 * 60)
    df = spark.createDataFrame([(1, t0 + dt.timedelta(minutes=m)) for m in minutes], "site_id bigint, t_stamp timestamp")
    got = [r.segment_id for r in clearsky.segment_gaps(df).orderBy("t_stamp").collect()]
    assert got == [0, 0, 0, 1, 1, 0]


def test_frame_quantile_matches_brute_force(spark):
    rng = random.Random(4)
    values = [None if rng.random() < 0.3 else rng.random() for _ in range(300)]
    df = spark.createDataFrame([(i // 40, i, v) for i, v in enumerate(values)], "g int, t int, x double")
    w = Window.partitionBy("g").orderBy("t")
    got = [r.q for r in df.select("t", frame_quantile(F.col("x"), w).alias("q")).orderBy("t").collect()]
    for i, q in enumerate(got):
        frame = sorted(v for j, v in enumerate(values) if j // 40 == i // 40 and abs(i - j) <= 3 and v is not None)
        assert q == (frame[-(-len(frame) * 3 // 5) - 1] if frame else None)


@pytest.mark.parametrize("ghi, minimum, clear", [
    ((501.0, 502.0, 603.0), 500.0, False), ((501.0, 502.0, 603.0), 700.0, False), ((501.0, 502.0, 503.0), 500.0, True),
    ((501.0, 502.0, 503.0), 504.0, False)])
def test_detect_clear_sky_day(spark, ghi, minimum, clear):
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate(ghi)], "day string, time int, ghi_mean double")
    assert clearsky.detect_clear_sky_day(df, min_max_ghi=minimum).first().is_clear_algo is clear


def grid(spark):
    """Two months of one cell: cloud sum of day d is d, except for a dark clear day."""
    rows = []
    for day in range(1, 11):
        for hour in range(3):
            rows.append((dt.datetime(2024, 1, day, hour), -10.0, 120.0, 100.0 if day == 1 else 500.0, 0 if day == 1 else day))
    return spark.createDataFrame(rows, "time timestamp, latitude double, longitude double, GHI double, cloud_type int")


def test_clear_sky_days_rank_before_the_peak_filter(spark):
    got = clearsky.clear_sky_days(grid(spark)).orderBy("day").collect()
    assert [(r.day.day, r.rn) for r in got] == [(2, 2), (3, 3)]
    assert clearsky.clear_sky_days(grid(spark), cloud_below=7).count() == 1
    assert clearsky.clear_sky_days(grid(spark), max_rank=29, cloudless=True).count() == 0
    assert [r.day.day for r in clearsky.zero_cloud_days(grid(spark)).collect()] == [1]


def test_hold_to_5min(spark):
    held = clearsky.hold_to_5min(grid(spark))
    assert held.count() == 60
    assert held.where(F.minute("time_5min") == 5).count() == 30


def test_solar_by_postcode_matches_on_hundredths(spark):
    points = spark.createDataFrame([(-10.001, 120.004, 2000), (-10.02, 120.0, 2001)],
                                   "latitude double, longitude double, postcode int")
    rows = clearsky.solar_by_postcode(grid(spark), points, ("GHI",), required="GHI")
    assert {r.postcode for r in rows.collect()} == {2000} and rows.count() == 30


def test_structured_data_pairs_each_row_with_the_nearest_clear_day(spark):
    """One site, two days, the first of them clear: both get the first day's profile."""
    cells = (-10.0, 120.0)
    times = [dt.datetime(2024, 1, d, 0, 0) + dt.timedelta(minutes=5 * i) for d in (1, 2) for i in range(12)]
    sun = [(t, *cells, 800.0 if t.day == 1 else 400.0, 0 if t.day == 1 else 9) for t in times if t.minute % 10 == 0]
    solar = spark.createDataFrame(sun, "time timestamp, latitude double, longitude double, GHI double, cloud_type int")
    site = spark.createDataFrame(
        [(1, t, 4.0 if t.day == 1 else 2.0, 0.0, 240.0, 5.0, 4.0, *cells) for t in times],
        "site_id bigint, t_stamp timestamp, P_kW double, Q_kvar double, V double, ac_capacity_kw double, S_99 double, "
        "latitude double, longitude double")
    rows = clearsky.structured_data(site, solar).where("actual_day = date '2024-01-02'").collect()
    # day 2 is itself among the three clearest days of its month, so it is its own reference
    assert {(r.cs_day.day, r.P_kw_norm, r.P_kw_norm_cs, r.GHI, r.GHI_cs) for r in rows} == {(2, 0.5, 0.5, 400.0, 400.0)}
    dark = solar.withColumn("GHI", F.when(F.dayofmonth("time") == 2, 150.0).otherwise(F.col("GHI")))
    rows = clearsky.structured_data(site, dark).where("actual_day = date '2024-01-02'").collect()
    assert len(rows) == 12
    assert {(r.cs_day.day, r.P_kw_norm, r.P_kw_norm_cs, r.GHI, r.GHI_cs) for r in rows} == {(1, 0.5, 1.0, 150.0, 800.0)}
