from __future__ import annotations

import math
import random

import numpy as np
import pytest

from pvgrid.operators import spatial

POINT = "id bigint, latitude double, longitude double"


def points(n, seed, crowd=0.0):
    """Random points; a share of them crowded into a hundredth of a degree."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if rng.random() < crowd:
            out.append((i, -33.0 + rng.random() / 100, 151.0 + rng.random() / 100))
        else:
            out.append((i, -40.0 + rng.randrange(3000) / 100, 115.0 + rng.randrange(3800) / 100))
    return out


@pytest.mark.parametrize("k, crowd", [(1, 0.0), (1, 0.5), (3, 0.5)])
def test_nearest_point_matches_brute_force(spark, k, crowd):
    left, right = points(300, 1, crowd), points(400, 2, crowd)
    right += [(1000 + i, la, lo) for i, (_, la, lo) in enumerate(right[:20])]  # shared positions
    ldf = spark.createDataFrame(left, POINT.replace("id", "pid"))
    rdf = spark.createDataFrame(right, POINT.replace("id", "rid"))
    got = {}
    for r in spatial.nearest_point(ldf, rdf, "pid", "rid", k=k).collect():
        got.setdefault(r.pid, []).append((r.distance_km, r.rid))
    for pid, la, lo in left:
        best = sorted(((lo - b) ** 2 + (la - a) ** 2, rid) for rid, a, b in right)[:k]
        assert sorted(got[pid]) == [(pytest.approx(d2 ** 0.5 * 111), rid) for d2, rid in best]


def test_nearest_point_cut_off_and_edge_cases(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 5.0), (3, None, 1.0)], POINT.replace("id", "pid"))
    right = spark.createDataFrame([(9, 0.0, 0.01)], POINT.replace("id", "rid"))
    near = spatial.nearest_point(left, right, "pid", "rid", max_km=2.22).collect()
    assert [(r.pid, r.rid, round(r.distance_km, 2)) for r in near] == [(1, 9, 1.11)]
    assert spatial.nearest_point(left, right, "pid", "rid", k=2).count() == 2
    with pytest.raises(ValueError):
        spatial.nearest_point(left, right.where("rid < 0"), "pid", "rid")


def inside(x, y, ring):
    """Strictly inside by winding over exact integer edges."""
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return False
        if (y1 > y) != (y2 > y) and (cross > 0) == (y2 > y1):
            odd = not odd
    return odd


def test_points_in_concave_polygons(spark):
    rings = {1: [(0, 0), (8, 0), (8, 8), (4, 3), (0, 8)], 2: [(6, 6), (12, 6), (9, 12)], 3: [(-5, -5), (-1, -5), (-1, -1)]}
    polygons = spark.createDataFrame(
        [(k, [(float(x), float(y)) for x, y in ring]) for k, ring in rings.items()],
        "poly int, vertices array<struct<x: double, y: double>>")
    grid = [(i, y / 2, x / 2) for i, (x, y) in enumerate((x, y) for x in range(-12, 28) for y in range(-12, 28))]
    df = spark.createDataFrame(grid, POINT)
    got = {(r.id, r.poly) for r in spatial.points_in_polygons(df, polygons, "poly", cell_degrees=1.5).collect()}
    assert got == {(i, k) for i, y, x in grid for k, ring in rings.items() if inside(x, y, ring)}


@pytest.mark.parametrize("cell", [0.5, 3.0])
def test_polygons_with_parts_and_holes_match_brute_force(spark, cell):
    rng = random.Random(11)
    rings = {1: [[(0, 0), (6, 0), (6, 6), (0, 6)], [(2, 2), (2, 4), (4, 4), (4, 2)], [(8, 0), (9, 0), (9, 5)]],
             2: [[(2.25, 2.25), (3.75, 2.25), (3, 3.75)], [(-4, -4), (7, -1), (-3, 5)]]}
    spots = [(i, rng.randrange(-20, 40) / 4, rng.randrange(-20, 40) / 4) for i in range(900)]

    def within(px, py, parts):
        odd = False
        for ring in parts:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                side = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
                if side == 0 and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
                    return False
                odd ^= (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1
        return odd

    points_df = spark.createDataFrame([(i, y, x) for i, x, y in spots], POINT)
    shapes = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in ring]) for k, parts in rings.items() for ring in parts],
                                   "key int, vertices array<struct<x double, y double>>")
    got = sorted((r.id, r.key) for r in spatial.points_in_polygons(points_df, shapes, "key", cell).collect())
    assert got == sorted((i, k) for i, x, y in spots for k, parts in rings.items() if within(x, y, parts))


def crossings_inside(x, y, edges):
    """Even-odd rule over all edges at once; points on an edge are not inside."""
    x1, y1, x2, y2 = edges.T
    side = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    if ((side == 0) & (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= y) & (y <= np.maximum(y1, y2))).any():
        return False
    up = (y1 > y) != (y2 > y)
    at = x1[up] + (y - y1[up]) * (x2[up] - x1[up]) / (y2[up] - y1[up])
    return bool((x < at).sum() % 2)


def ring_edges(ring):
    a = np.array(ring, float)
    return np.hstack([a, np.roll(a, -1, axis=0)])


def coastline(n, seed, x0=0.0, y0=0.0, radius=10.0):
    """A closed ring of n short edges around (x0, y0)."""
    rng = np.random.default_rng(seed)
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = radius * (1 + 0.2 * np.sin(7 * angle) + 0.0003 * rng.standard_normal(n))
    return list(zip((x0 + r * np.cos(angle)).tolist(), (y0 + r * np.sin(angle)).tolist()))


SHAPES = "key int, vertices array<struct<x double, y double>>"


def test_large_polygons_and_a_crowded_city(spark):
    rng = np.random.default_rng(5)
    rings = {1: [coastline(100_000, 1), coastline(2000, 2, 1.0, 1.0, 3.0)], 2: [coastline(3000, 3, 4.0, -2.0, 8.0)]}
    rings |= {10 + k: [coastline(12, 100 + k, 5 + rng.uniform(-.01, .01), 5 + rng.uniform(-.01, .01), 0.002)] for k in range(300)}
    coast = rings[1][0]
    spots = [(float(a), float(b)) for a, b in rng.uniform(-14, 14, (600, 2))]
    spots += [(5 + float(a), 5 + float(b)) for a, b in rng.uniform(-.012, .012, (1500, 2))]           # the city
    spots += [coast[k] for k in range(0, 100_000, 4000)]                                               # on a vertex
    spots += [(coast[k][0] + d, coast[k][1]) for k in range(0, 100_000, 3000) for d in (-1e-3, 1e-3, -1e-6)]
    spots += [(-13.0, coast[k][1]) for k in range(0, 100_000, 9000)] + [(0.5, coast[k][1]) for k in range(0, 100_000, 9000)]
    want = set()
    for key, parts in rings.items():
        edges = np.vstack([ring_edges(r) for r in parts])
        low, high = edges[:, :2].min(0), edges[:, :2].max(0)
        want |= {(i, key) for i, (a, b) in enumerate(spots) if low[0] <= a <= high[0] and low[1] <= b <= high[1] and crossings_inside(a, b, edges)}
    df = spark.createDataFrame([(i, b, a) for i, (a, b) in enumerate(spots)], POINT)
    shapes = spark.createDataFrame([(k, ring) for k, parts in rings.items() for ring in parts], SHAPES)
    cells, _ = spatial.polygon_cells(shapes.where("key = 2"), "key")
    sizes = cells.selectExpr("max(size(edges)) AS e", "max(size(ends)) AS s", "count(*) AS n").first()
    assert sizes.e <= spatial.CELL_EDGES and sizes.s <= 2 * spatial.CELL_EDGES + 1 and sizes.n < 3000
    assert {(r.id, r.key) for r in spatial.points_in_polygons(df, shapes, "key").collect()} == want


@pytest.mark.parametrize("cell_edges", [3, 6])
def test_small_cells_on_quarters_match_brute_force(spark, cell_edges):
    """Vertices, points and cell borders coincide; edges share vertices and run along borders."""
    rng = random.Random(21)
    rings = {k: [[(rng.randrange(-16, 17) / 4, rng.randrange(-16, 17) / 4) for _ in range(rng.randint(3, 9))]
                 for _ in range(rng.randint(1, 3))] for k in range(12)}
    rings[50] = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 1), (2, 1), (2, 2)], [(3, 3)], []]
    rings[51] = [[(0, 0), (1, 0)]]                     # no area
    rings[52] = [[(2, 2), (2, 2), (2, 2)]]
    rings[53] = [[(0, 0)] + [(math.cos(a), math.sin(a)) if a % 2 else (0, 0) for a in range(120)]]  # many edges in a point
    spots = [(x / 8, y / 8) for x in range(-36, 37, 2) for y in range(-36, 37, 3)]
    edges = {k: np.vstack([ring_edges(r) for r in parts if len(r) > 1]) for k, parts in rings.items()}
    want = {(i, k) for k, e in edges.items() for i, (a, b) in enumerate(spots) if crossings_inside(a, b, e)}
    odd = [(9000, None, 1.0), (9001, 1.0, float("nan")), (9002, float("inf"), 0.0), (9003, 1e300, 1e300)]
    df = spark.createDataFrame([(i, b, a) for i, (a, b) in enumerate(spots)] + odd, POINT)
    shapes = spark.createDataFrame([(k, [(float(a), float(b)) for a, b in r]) for k, parts in rings.items() for r in parts], SHAPES)
    got = {(r.id, r.key) for r in spatial.points_in_polygons(df, shapes, "key", cell_edges=cell_edges).collect()}
    assert got == want
    assert spatial.points_in_polygons(df, shapes.where("key > 99"), "key").collect() == []
    assert spatial.points_in_polygons(df.where("id < 0"), shapes, "key").collect() == []
