from __future__ import annotations

import datetime as dt

import pytest

from pvgrid.functions import localtime
from pvgrid.operators import quality, series
from pvgrid.operators.site import normalise, scrub_voltage, site_power, site_power_by_role
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1, 0, 0)
TS = "circuit_id bigint, t_stamp timestamp, is_pv boolean, power double, energy_reactive double, voltage double"
META = ("site_id bigint, circuit_id bigint, circuit_polarity int, ac_capacity_kw double, S_99 double, "
        "is_pv boolean, circuit_type string")


@pytest.fixture(scope="module")
def meta(spark):
    rows = [(1, 10, 1, 5.0, 4.0, True, "pv_site_net"), (1, 11, -1, 6.0, 4.0, True, "pv_inverter"),
            (1, 12, 1, 5.0, 4.0, False, "ac_load_net"), (2, 20, 1, 3.0, 2.0, True, "pvx")]
    return spark.createDataFrame(rows + rows[:1], META)  # one circuit listed twice


@pytest.fixture(scope="module")
def ts(spark):
    return spark.createDataFrame([
        (10, T0, True, 1000.0, 10.0, 240.0), (11, T0, True, -500.0, -5.0, 250.0),
        (12, T0, False, 700.0, 0.0, 245.0), (20, T0, True, 100.0, 1.0, 300.0),
        (20, T0 + dt.timedelta(minutes=5), True, None, 1.0, 230.0),
        (99, T0, True, 1.0, 1.0, 230.0), (10, T0 + dt.timedelta(minutes=5), True, 1.0, 1.0, None)], TS)


def test_site_power_sums_circuits_once(ts, meta):
    rows = {(r.site_id, r.t_stamp): r for r in site_power(ts, meta).collect()}
    assert len(rows) == 2
    r = rows[(1, T0)]
    assert (r.P_kW, r.V, r.ac_capacity_kw, r.S_99) == (1.5, 245.0, 6.0, 4.0)
    assert r.Q_kvar == pytest.approx(0.18)
    assert rows[(2, T0 + dt.timedelta(minutes=5))].P_kW is None


def test_site_power_variants(ts, meta):
    r = site_power(ts, meta, v_hi=350, v_agg="max", capacity="key").where("site_id = 1").collect()
    assert sorted((x.ac_capacity_kw, x.V) for x in r) == [(5.0, 240.0), (6.0, 250.0)]
    closed = site_power(ts, meta, inclusive=True).where("site_id = 2").count()
    assert closed == 2
    late = site_power(ts, meta, v_lo=None, v_hi=None, scrub_after=(0, 290), capacity="avg")
    assert late.where("site_id = 2").count() == 1


def test_roles(ts, meta):
    r = site_power_by_role(ts, meta.where("ac_capacity_kw < 6")).where("site_id = 1").first()
    assert (r.P_pv, r.P_net, r.P_other, r.V) == (1.0, 0.7, None, 242.5)


def test_pv_pattern_has_a_wildcard(ts, meta):
    # 'pvx' has no underscore, but the pattern's underscore stands for any character
    r = site_power_by_role(ts, meta, v_hi=301).where("site_id = 2").orderBy("t_stamp").first()
    assert (r.P_pv, r.P_other) == (0.1, None)


def test_normalise_and_scrub(spark, ts, meta):
    r = normalise(site_power(ts, meta)).where("site_id = 1").first()
    assert r.P_kw_norm == pytest.approx(0.375) and r.S_norm == pytest.approx((0.375**2 + 0.045**2) ** 0.5)
    assert scrub_voltage(ts, 50, 290).where("voltage IS NULL").count() == 2
    assert scrub_voltage(ts, 50, 290, drop=True).count() == 5


def test_exact_sum_is_independent_of_partitioning(spark):
    df = spark.range(0, 20000, 1, 16).select((F.rand(3) * 1e4).alias("x"))
    df.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/order")
    from pvgrid.functions.exact import exact_sum
    a = spark.read.parquet(path).agg(exact_sum(F.col("x"))).first()[0]
    b = spark.read.parquet(path).orderBy("x").coalesce(1).agg(exact_sum(F.col("x"))).first()[0]
    assert a == b


@pytest.mark.parametrize("rule, hours", [
    ("utc_20_7", {20, 21, 22, 23, 0, 1, 2, 3, 4, 5, 6, 7}),
    ("local_8_16", {22, 23, 0, 1, 2, 3, 4, 5, 6}), ("local_9_16", {23, 0, 1, 2, 3, 4, 5, 6})])
def test_day_night_rules(spark, rule, hours):
    df = spark.range(24).select(F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit(T0)).alias("t"))
    day = df.where(localtime.day_night(F.col("t"), rule) == "day").select(F.hour("t")).collect()
    assert {r[0] for r in day} == hours


def test_time_bins(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 15, 44, 59),)], "t timestamp")
    r = df.select(localtime.tod_bin(F.col("t")), localtime.tod_bin(F.col("t"), 30),
                  localtime.dated_bin(F.col("t")), localtime.local_day(F.col("t"))).first()
    assert tuple(r) == (100, 90, dt.datetime(2024, 1, 2, 1, 30), dt.date(2024, 1, 2))


def test_sampling_interval_and_duplicates(spark):
    rows = [(1, T0), (1, T0 + dt.timedelta(minutes=10)), (1, T0 + dt.timedelta(minutes=15)), (2, T0), (2, T0), (3, T0)]
    df = spark.createDataFrame(rows, "circuit_id bigint, t_stamp timestamp")
    got = {r.circuit_id: r.min_diff_seconds for r in quality.sampling_interval(df).collect()}
    assert got == {1: 300, 2: 0, 3: None}
    assert [tuple(r) for r in quality.duplicate_readings(df).collect()] == [(2, T0, 2)]


def test_energy_to_power_and_periods(spark):
    rows = [(1, T0 + dt.timedelta(minutes=m), 2.0) for m in (0, 5, 10, 1440)]
    rows += [(2, T0 + dt.timedelta(minutes=m), 2.0) for m in (0, 30, 60)]
    df = spark.createDataFrame(rows, "site_id bigint, t_stamp timestamp, e double")
    power = series.energy_to_power(df, "site_id", "t_stamp", ("e",))
    got = {(r.site_id, r.e, r.mixed_steps) for r in power.collect()}
    assert got == {(1, 24.0, True), (2, 4.0, False)}
    lists = {(r.num_periods, r.site_id): r.e for r in
             series.period_series(df, "t_stamp", "site_id", ("e",)).collect()}
    assert {k: len(v) for k, v in lists.items()} == {(2, 1): 1, (1, 1): 3, (2, 2): 1, (1, 2): 2}
    total = series.add_total_group(df, "t_stamp", "site_id", {"e": F.sum("e")})
    assert total.where("site_id = 'All'").count() == 6
