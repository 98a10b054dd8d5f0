"""Whitening against a dense eigenvalue solver and whole numbers of any size."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pvgrid.llm.whitening import below, feast, intervals, principal, whiten

VECTORS = "vec_id bigint, embedding array<float>"


def check(rows, vectors, components=32):
    """Compare returned rows with exact sums and numpy's solver over (id, vector) pairs."""
    x = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in vectors]
    n, d = len(x), len(x[0][1])
    s = [sum(v[k] for _, v in x) for k in range(d)]
    y = np.array([[float(v[k] - Fraction(s[k], n)) for k in range(d)] for _, v in x])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > 1e-10 * e.sum()).sum()))
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert len(rows) == n * k and sorted(by_id, key=repr) == sorted({i for i, _ in x}, key=repr)
    got = np.array([[by_id[i][c + 1].whitened for c in range(k)] for i, _ in x])
    for (i, v), line in zip(x, got):
        assert {r.deviation for r in by_id[i].values()} == {sum((n * a - b) ** 2 for a, b in zip(v, s))}
    want = y @ q[:, :k] / np.sqrt(e[:k])
    got *= np.sign((got * want).sum(axis=0))
    apart = np.array([min([abs(e[c] - e[o]) for o in range(d) if o != c], default=1) / e[0] for c in range(k)])
    for c in range(k):
        if apart[c] > 1e-6:
            assert np.allclose(got[:, c], want[:, c], atol=1e-9 / apart[c]), c
    assert np.allclose(got.T @ got / n, np.eye(k), atol=1e-9)
    any_id = next(iter(by_id.values()))
    assert np.allclose([any_id[c + 1].explained for c in range(k)], e[:k] / e.sum(), rtol=1e-9)
    assert {r.n for r in rows} == {n} and all(0 <= r.identity_error < 1e-9 for r in rows)
    assert len({r.identity_error for r in rows}) == 1


def frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS id", "'x' AS x", "2 AS component", "3 AS n", "4 AS whitened")


def test_whitened_matches_a_dense_solver(spark):
    rng = np.random.default_rng(1)
    mix = rng.standard_normal((40, 40)) * (0.8 ** np.arange(40))
    rows = [(i, list(map(float, v))) for i, v in enumerate((rng.standard_normal((300, 40)) @ mix).astype(np.float32))]
    bad = [(900, None), (901, [None] * 40), (902, [float("nan")] + [0.0] * 39), (903, [float("inf")] * 40), (904, [-float("inf")] * 40),
           (905, [1.0, 2.0]), (906, [])]
    check(whiten(frame(spark, rows + bad)).collect(), rows)
    check(whiten(frame(spark, rows).repartition(7), components=5).collect(), rows, 5)


def test_repeated_rows_null_ids_and_few_directions(spark):
    rng = np.random.default_rng(2)
    flat = rng.standard_normal((30, 3)).astype(np.float32) @ rng.integers(-2, 3, (3, 9)).astype(np.float32)
    rows = [(i, list(map(float, np.round(v * 64) / 64))) for i, v in enumerate(flat)]
    check(whiten(frame(spark, rows)).collect(), rows)
    got = whiten(frame(spark, rows + [(None, rows[0][1]), (3, rows[3][1])])).groupBy("vec_id").count().collect()
    per = {r[0]: r[1] for r in got}
    assert per[3] == 2 * per[4] and per[None] == per[4]


def test_tables_without_components(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        got = whiten(frame(spark, rows))
        assert got.collect() == []
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_long_vectors_of_large_entries(spark):
    rows = [(i, [float(np.float32(1e9 * math.sin(i * k + k))) for k in range(1, 5)]) for i in range(50)]
    got = whiten(frame(spark, rows)).collect()
    assert len(got) == 200 and all(r.deviation is None for r in got if r.vec_id) and got[0].identity_error < 1e-9
    small = [(i, [float(np.float32(3e4 * math.sin(i * k + k))) for k in range(1, 5)]) for i in range(50)]
    check(whiten(frame(spark, small)).collect(), small)


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))
    v = q @ np.diag(values) @ q.T
    return (v + v.T) / 2


CASES = {
    "spread": np.geomspace(1, 1e-6, 50), "even": np.linspace(1, 2, 60), "equal": np.ones(20), "two": np.r_[np.ones(15), np.full(15, 2.0)],
    "close": 1 + 1e-7 * np.arange(40), "pairs": np.repeat(np.arange(1.0, 25), 2) + np.tile([0, 1e-9], 24),
    "rank": np.r_[np.zeros(30), 1, 2, 3], "one": np.array([2.5]), "cut in a cluster": np.r_[np.full(31, 5.0), np.full(9, 4.0), 1.0],
}


@pytest.mark.parametrize("name", CASES)
def test_components_of_known_spectra(spark, name):
    values = np.sort(CASES[name])[::-1]
    v = spectrum(values)
    k = min(32, int((values > 1e-9).sum()))
    e, q = principal(spark, v, 32)
    assert len(e) == k and np.allclose(e, values[:k], rtol=1e-9, atol=1e-13)
    assert np.allclose(q.T @ q, np.eye(k), atol=1e-12) and np.allclose(v @ q, q * e, atol=1e-11)
    parts = intervals(v, 32)
    assert sum(p[2] for p in parts) >= k
    for low, high, count in parts:
        assert count == ((values > low) & (values < high)).sum()
        assert len(feast(v, low, high, count)[0]) == count


def test_inertia_counts():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 10, 31):
        for _ in range(20):
            a = rng.standard_normal((n, n)) * rng.choice([0, 1, 1], (n, n))
            a = a + a.T
            e = np.linalg.eigvalsh(a)
            for s in rng.standard_normal(5) * 2:
                assert below(a, s) == (e < s).sum()
    assert below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1 and below(np.zeros((3, 3)), 0.0) == 0
