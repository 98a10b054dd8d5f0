from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from pvgrid.functions import curves


def evaluate(spark, build, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(build(*[F.col(c) for c in df.columns])).collect()]


@pytest.mark.parametrize("v, limit", [
    (252.9, 10.0), (253.0, 10.0), (256.5, 6.0), (260.0, 2.0), (260.1, 2.0), (None, None)])
def test_voltwatt_limit(spark, v, limit):
    got = evaluate(spark, lambda v: curves.voltwatt_limit(v, F.lit(10.0)), [(v,)], "v double")[0]
    assert got == (None if limit is None else pytest.approx(limit))


@pytest.mark.parametrize("v, q", [
    (206.0, 4.4), (207.0, 4.4), (213.5, 2.2), (220.0, 0.0), (230.0, 0.0), (240.0, 0.0), (249.0, -3.0),
    (258.0, -6.0), (270.0, -6.0), (None, None)])
def test_voltvar_q(spark, v, q):
    got = evaluate(spark, lambda v: curves.voltvar_q(v, F.lit(10.0)), [(v,)], "v double")[0]
    assert got == (None if q is None else pytest.approx(q, abs=1e-12))


def test_voltvar_q_gated_is_zero_at_low_power(spark):
    got = evaluate(spark, lambda v, p: curves.voltvar_q_gated(v, p, F.lit(10.0)),
                   [(258.0, 1.9), (258.0, -1.9), (258.0, 2.0)], "v double, p double")
    assert got == [0.0, 0.0, pytest.approx(-6.0)]


@pytest.mark.parametrize("p, q", [
    (1.9, 0.0), (2.0, 4.4), (-6.0, 4.4), (6.0, 4.4), (7.0, math.sqrt((7 / 0.8) ** 2 - 49)),
    (8.0, 6.0), (9.0, math.sqrt(19)), (10.0, 0.0), (12.0, 0.0)])
def test_q_capability(spark, p, q):
    got = evaluate(spark, lambda p: curves.q_capability(p, F.lit(10.0)), [(p,)], "p double")[0]
    assert got == pytest.approx(q, abs=1e-9)


def test_unclamped_capability_is_nan_beyond_rating(spark):
    got = evaluate(spark, lambda p: curves.q_capability(p, F.lit(10.0), clamp=False), [(12.0,)], "p double")[0]
    assert math.isnan(got)


@pytest.mark.parametrize("q_set, cap, upper, lower", [
    (0.0, 4.4, 0.4, -0.4),       # dead band
    (-6.0, 4.4, -4.0, -6.4),     # absorbing more than possible relaxes the upper bound
    (-3.0, 4.4, -2.6, -3.4),     # absorbing within reach
    (4.4, 2.0, 4.8, 1.6),        # supplying more than possible relaxes the lower bound
    (2.2, 4.4, 2.6, 1.8),
])
def test_q_band(spark, q_set, cap, upper, lower):
    df = spark.createDataFrame([(q_set, cap)], "q double, c double")
    hi, lo = curves.q_band(F.col("q"), F.col("c"), F.lit(10.0))
    row = df.select(hi, lo).first()
    assert row[0] == pytest.approx(upper) and row[1] == pytest.approx(lower)


@pytest.mark.parametrize("q, upper, lower, impact", [
    (-3.0, -2.0, -4.0, 0.75),    # nearer bound is the lower one: ratio 3/4 < 3/2
    (3.0, -2.0, -4.0, -0.75),    # opposite direction
    (0.5, 0.4, -0.4, 1.25),      # symmetric band: always counted as same direction
    (-0.5, 0.4, -0.4, 1.25),
    (0.0, -2.0, -4.0, 0.0),
    (1.0, 2.0, 2.0, 0.5),
])
def test_q_impact(spark, q, upper, lower, impact):
    got = evaluate(spark, curves.q_impact, [(q, upper, lower)], "q double, u double, l double")[0]
    assert got == pytest.approx(impact, abs=1e-6)


def test_power_factor_of_no_power_is_null(spark):
    got = evaluate(spark, curves.power_factor, [(0.0, 0.0), (3.0, 4.0), (-3.0, 4.0)], "p double, q double")
    assert got == [None, pytest.approx(0.6), pytest.approx(-0.6)]
