from __future__ import annotations

import datetime as dt
import random

import pytest

from pvgrid.operators import sequences

SITE = "site_id bigint, t_stamp timestamp, P_kW double, V double, ac_capacity_kw double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for site in (1, 2, 3):
        t = dt.datetime(2024, 1, 31, 20, 0)
        for _ in range(120):
            t += dt.timedelta(minutes=5 * rng.choice((1, 1, 1, 2)))
            out.append((site, t, rng.choice((0.0, 0.1, 0.2, 0.5, 3.0)), rng.choice((252.0, 256.0, 259.0, 261.0, 264.0)), 5.0))
    return out


def brute(rows, thresholds, rule, day_only):
    """Counts per (site, day, day_night, threshold) with lags that restart each month."""
    out = {}
    floor = 0.2
    series = {}
    for r in sorted(rows):
        series.setdefault((r[0], r[1].year, r[1].month), []).append(r)
    for (site, _, month), s in series.items():
        for i, r in enumerate(s):
            v = [s[i - k][3] if i >= k else None for k in range(4)]
            p = [s[i - k][2] if i >= k else None for k in range(4)]
            hot = [x is not None and x > floor for x in p]
            for thr in thresholds:
                up = [x is not None and x >= thr for x in v]
                keep = {
                    "two_sample": up[0] and up[1] and any(hot[:3]),
                    "one_sample_or_power": up[0] and (up[1] or hot[1] or hot[0]),
                    "voltage_only": up[0],
                    "sustained": up[0] and up[1] and (up[2] or hot[2] or hot[0]),
                    "sustained_3w": up[0] and up[1] and up[2] and any(hot),
                }[rule]
                day = "day" if r[1].hour >= 20 or r[1].hour <= 7 else "night"
                if keep and (day == "day" or not day_only):
                    key = (site, month, r[1].day, day, float(thr))
                    n, pos, total = out.get(key, (0, 0, 0.0))
                    excess = r[2] - floor if r[2] >= floor else 0.0
                    out[key] = (n + 1, pos + (excess > 0), total + excess)
    return out


@pytest.mark.parametrize("rule", list(sequences.RULES))
@pytest.mark.parametrize("day_only", [False, True])
def test_sweep_matches_brute_force(spark, rows, rule, day_only):
    thresholds = (255, 260, 263)
    got = sequences.threshold_sweep(spark.createDataFrame(rows, SITE), thresholds, rule, "x", day_only).collect()
    want = brute(rows, thresholds, rule, day_only)
    assert {(r.site_id, r.month, r.day, r.day_night, r.v_threshold): (r.total_count, r.x_count, pytest.approx(r.x_sum))
            for r in got} == want


def test_lags_can_cross_months(spark, rows):
    df = spark.createDataFrame(rows, SITE)
    reset = sequences.with_lags(df, 1).where("prev_V_1 IS NULL").count()
    across = sequences.with_lags(df, 1, reset_monthly=False).where("prev_V_1 IS NULL").count()
    assert (reset, across) == (6, 3)


def test_flex_export_needs_five_flat_samples_below_the_peak(spark):
    t0 = dt.datetime(2024, 1, 1, 22, 0)
    day = [10.0, 8.0] + [3.0] * 5 + [9.0]
    short = [10.0, 8.0] + [3.0] * 4 + [9.0]
    near_peak = [10.0] * 6
    rows = [(s, t0 + dt.timedelta(minutes=5 * i), p, 240.0, 10.0)
            for s, profile in ((1, day), (2, short), (3, near_peak)) for i, p in enumerate(profile)]
    df = spark.createDataFrame(rows, SITE)
    assert [tuple(r) for r in sequences.flex_export_sites(df).collect()] == [(1, dt.date(2024, 1, 2))]
    assert [r.site_id for r in sequences.flex_export_rows(df).collect()] == [1]
    small = spark.createDataFrame([(s, t, p, v, 4.0) for s, t, p, v, _ in rows], SITE)
    assert sequences.flex_export_sites(small).count() == 0


def test_flag_flex_export(spark):
    meta = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "site_id bigint, circuit_id bigint")
    sites = spark.createDataFrame([(1,), (1,)], "site_id bigint")
    got = {r.circuit_id: r.flex_export_detected for r in sequences.flag_flex_export(meta, sites).collect()}
    assert got == {10: True, 11: True, 20: False}


def test_lags_across_months_match_brute_force(spark):
    """Months with one row, or none, between those a lag reaches over."""
    rng = random.Random(8)
    rows = []
    for s in (1, 2, None):
        for m in range(1, 13):
            days = sorted(rng.sample(range(1, 28), rng.choice([0, 1, 1, 2, 9])))
            rows += [(s, dt.datetime(2024, m, d), 230.0 + rng.randrange(40), rng.random()) for d in days]
    df = spark.createDataFrame([(*r, 5.0) for r in rows], "site_id bigint, t_stamp timestamp, V double, P_kW double, ac_capacity_kw double")
    want = set()
    for s in (1, 2, None):
        mine = sorted(r[1:] for r in rows if r[0] == s)
        for k, r in enumerate(mine):
            want.add((s, r[0], *[mine[k - i][c] if k >= i else None for i in (1, 2, 3) for c in (1, 2)]))
    got = sequences.with_lags(df, 3, reset_monthly=False)
    assert got.columns[:5] == df.columns
    names = [f"prev_{n}_{i}" for i in (1, 2, 3) for n in "VP"]
    assert {(r.site_id, r.t_stamp, *[r[n] for n in names]) for r in got.collect()} == want and got.count() == len(rows)
