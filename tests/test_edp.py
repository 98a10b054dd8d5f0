from __future__ import annotations

import datetime as dt
import random

import pytest

from pvgrid.operators import edp

T0 = dt.datetime(2024, 1, 1, 20, 0)


def brute_fill(series):
    """Linear fill of the first missing value of each gap, by time."""
    out = [v for _, v in series]
    for i, (t, v) in enumerate(series):
        if v is None and i and series[i - 1][1] is not None:
            t0, v0 = series[i - 1]
            later = [(b, w) for b, w in series[i + 1:] if w is not None]
            out[i] = v0 if not later else v0 + (later[0][1] - v0) * ((t - t0) / (later[0][0] - t0))
    return out


def test_interpolate_time_matches_brute_force_across_days(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for key in (1, 2, 3):
        t, series = T0, []
        for _ in range(150):
            t += dt.timedelta(minutes=rng.choice((5, 5, 60, 400)))
            series.append((t, None if rng.random() < 0.45 else rng.random()))
        rows += [(key, t, v) for t, v in series]
        want.update({(key, t): f for (t, _), f in zip(series, brute_fill(series))})
    df = spark.createDataFrame(rows, "postcode int, time timestamp, v double")
    got = edp.interpolate_time(df, ("postcode",), "time", ("v",))
    assert got.columns == df.columns
    for r in got.collect():
        expected = want[(r.postcode, r.time)]
        assert r.v == (None if expected is None else pytest.approx(expected))


def test_rating_uses_the_plain_rating_without_a_count(spark):
    sites = spark.createDataFrame([("S1", "SA", 5.0, 2), ("S1", "SA", 3.0, None), ("S2", "VIC", 5.0, 1), ("S3", "SA", 5.0, 1)],
                                  "edp_site_id string, state string, inverter_ac_rating_kw double, inverter_count int")
    codes = spark.createDataFrame([("S1", 5000), ("S2", 5001)], "edp_site_id string, postcode int")
    assert [tuple(r) for r in edp.edp_site_rating(sites, codes).collect()] == [("S1", 5000, 13.0)]


@pytest.fixture(scope="module")
def processed(spark):
    def row(site, minutes, energy, reactive, volts):
        return (site, "C", "D", "pv_site_net", T0 + dt.timedelta(minutes=minutes), energy, reactive, 1.0, volts)

    readings = spark.createDataFrame(
        [row("S1", 0, 400.0, 0.0, 245.0), row("S1", 5, 0.0, 0.0, 259.0), row("S1", 10, 900.0, -100.0, 310.0),
         row("S2", 0, 100.0, 0.0, 230.0)],
        "edp_site_id string, edp_circuit_label string, edp_device_and_circuit string, circuit_label string, "
        "datetime timestamp, real_energy double, reactive_energy double, current_avg double, voltage_avg double")
    ratings = spark.createDataFrame([("S1", 5000, 10.0), ("S2", 5000, 10.0)],
                                    "edp_site_id string, postcode int, Srated double")
    return edp.process_edp(readings, ratings, offset_minutes=570)


def test_process_edp(processed):
    rows = {(r.edp_site_id, r.time): r for r in processed.collect()}
    first = rows[("S1", T0 - dt.timedelta(minutes=570))]
    assert first.active_power == pytest.approx(4.8) and first.P_noncomp == 0.0
    assert first.Q_noncomp == pytest.approx(abs(6 * 5 / 18 - 0.5))
    odd = rows[("S1", T0 - dt.timedelta(minutes=560))]
    assert odd.voltage_avg is None and odd.P_noncomp is None and odd.Q_noncomp is None
    assert first.wrong_on_maxP is True and rows[("S2", T0 - dt.timedelta(minutes=570))].wrong_on_maxP is False


def test_trip_and_rankings(processed):
    trips = edp.trip_events(processed).collect()
    assert [(r.edp_site_id, r.DP_r, r.voltage_avg) for r in trips] == [("S1", -5.0, 259.0)]
    assert edp.trip_events(processed, loose=True).count() == 1
    ranking = [r.edp_site_id for r in edp.reactive_ranking(processed).collect()]
    assert ranking[0] == "S1"
    assert edp.active_ranking(processed, 253).count() == 1
    assert edp.voltwatt_violations(processed).count() == 0
    assert edp.voltvar_violations(processed).count() == 0


def test_multi_circuit_sites(spark):
    rows = [("S1", "A", T0, "x"), ("S1", "A", T0 - dt.timedelta(days=1), "y"), ("S1", "B", T0, "z"), ("S2", "A", T0, "x")]
    df = spark.createDataFrame([(s, c, d, "pv_site_net", t) for s, c, t, d in rows],
                               "edp_site_id string, edp_circuit_label string, edp_device_and_circuit string, "
                               "circuit_label string, datetime timestamp")
    got = sorted((r.edp_site_id, r.edp_circuit_label, r.edp_device_and_circuit, r.count_circuits)
                 for r in edp.multi_circuit_sites(df).collect())
    assert got == [("S1", "A", "y", 2), ("S1", "B", "z", 2)]
