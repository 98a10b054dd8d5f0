"""One site with 100 000 samples next to small ones: windows see a long, hot series and stay right."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pvgrid.operators import clearsky, edp, sequences, series

N = 100_000


@pytest.fixture(scope="module")
def rows(spark):
    """Site 1 has N samples with a gap of an hour after every 50th, sites 2 to 40 have ten each."""
    k = F.col("id")
    hot = spark.range(N).select(F.lit(1).cast("long").alias("site_id"), (k * 300 + F.floor(k / 50) * 3600).alias("s"), k)
    cold = spark.range(390).select((k % 39 + 2).alias("site_id"), (F.floor(k / 39) * 300).alias("s"), k)
    df = hot.unionByName(cold).select(
        "site_id", F.timestamp_seconds(F.col("s") + 1_704_067_200).alias("t_stamp"), (k % 97 / 10).alias("P_kW"),
        (F.lit(240.0) + k % 29).alias("V"), F.lit(5.0).alias("ac_capacity_kw"))
    path = f"{spark.conf.get('spark.checkpoint.dir')}/long-series"
    df.write.parquet(path)
    return spark.read.parquet(path)


def hot_site(df, *columns):
    table = df.where("site_id = 1").select("t_stamp", *columns).toPandas().sort_values("t_stamp")
    assert len(table) == N
    return table


def test_lags_restart_each_month(rows):
    got = hot_site(sequences.with_lags(rows, 2), "V", "prev_V_1", "prev_V_2")
    month = got["t_stamp"].dt.strftime("%Y%m").to_numpy()
    for k in (1, 2):
        want = np.full(N, np.nan)
        same = month[k:] == month[:-k]
        want[k:][same] = got["V"].to_numpy()[:-k][same]
        np.testing.assert_array_equal(got[f"prev_V_{k}"].to_numpy(float), want)


def test_segments_restart_each_day(rows):
    got = hot_site(clearsky.segment_gaps(rows), "day", "segment_id")
    day, t = got["day"].astype(str).to_numpy(), got["t_stamp"].to_numpy()
    gap = np.concatenate([[False], (np.diff(t) > np.timedelta64(30, "m")) & (day[1:] == day[:-1])])
    starts = np.concatenate([[True], day[1:] != day[:-1]])
    total = np.cumsum(gap)
    np.testing.assert_array_equal(got["segment_id"].to_numpy(), total - np.maximum.accumulate(np.where(starts, total, 0)))


def test_steps_and_trips_cross_days(rows):
    steps = {r.site_id: (r.step_seconds, r.mixed_steps) for r in series.sampling_steps(rows, "site_id", "t_stamp").collect()}
    assert steps[1] == (300, True) and all(steps[k] == (300, False) for k in range(2, 41))
    table = rows.select(F.col("site_id").alias("edp_site_id"), F.col("t_stamp").alias("time"),
                        F.when(F.col("P_kW") < 2, 0.0).otherwise(F.col("P_kW")).alias("active_power"), F.lit(259.0).alias("voltage_avg"))
    power = np.where(np.arange(N) % 97 / 10 < 2, 0.0, np.arange(N) % 97 / 10)
    falls = (np.round(np.minimum(np.diff(power), 0)) <= -1) & (power[1:] < 0.05)
    assert edp.trip_events(table).where("edp_site_id = 1").count() == falls.sum() > 1000


def test_distinct_times_are_exact_on_and_off_the_grid(spark):
    from pvgrid.functions.slots import distinct_times

    start = dt.datetime(2024, 1, 1)
    times = [start + dt.timedelta(minutes=5 * k) for k in range(8928)] * 2
    times += [start + dt.timedelta(minutes=5 * k, seconds=s, microseconds=u) for k in (0, 7) for s, u in ((1, 0), (1, 0), (0, 1))] + [None]
    df = spark.createDataFrame([(t, k % 2 == 0) for k, t in enumerate(times)], "t timestamp, even boolean")
    got = df.agg(distinct_times(F.col("t")).alias("n"), distinct_times(F.col("t"), F.col("even")).alias("e"),
                 distinct_times(F.col("t"), F.lit(None).cast("boolean")).alias("none")).first()
    assert (got.n, got.none) == (8928 + 4, 0)
    assert got.e == len({t for k, t in enumerate(times) if k % 2 == 0 and t})
    assert df.where("false").agg(distinct_times(F.col("t")).alias("n")).first().n == 0
