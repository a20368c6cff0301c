"""Sight, sweeps, polygons, roads and sources against plain computations."""

import json
import math
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import chains, grid, planar, ranking, render, routing, space, vector, visibility, zonal
from ridgeline.sources import fetch, paged, tables

RES = 10.0


def rough(seed, shape, spread=6.0):
    r = np.random.default_rng(seed)
    z = r.normal(0, 1, shape)
    for _ in range(3):
        z = (z + np.roll(z, 1, 0) + np.roll(z, 1, 1) + np.roll(z, (1, 1), (0, 1))) / 2
    return z * spread


def frame(spark, z):
    return spark.createDataFrame([(i, j, float(z[i, j])) for i in range(z.shape[0]) for j in range(z.shape[1])], "row int, col int, z double")


def plain_required(z, row, col, point, r, c, step=4.0):
    """The least height above ground at (r, c), sample by sample."""
    dist = math.hypot(r - row, c - col) * RES
    n = max(2, int(dist / step))
    fall = lambda d: visibility.CURVATURE * d * d / (2 * visibility.RADIUS)
    need = -math.inf
    for k in range(1, n):
        t = k / n
        y, x = row + (r - row) * t, col + (c - col) * t
        i, j = min(z.shape[0] - 2, int(y)), min(z.shape[1] - 2, int(x))
        fy, fx = y - i, x - j
        g = (z[i, j] * (1 - fx) + z[i, j + 1] * fx) * (1 - fy) + (z[i + 1, j] * (1 - fx) + z[i + 1, j + 1] * fx) * fy
        need = max(need, point + (g - fall(t * dist) - point) / t)
    return max(0.0, need + fall(dist) - z[r, c])


@pytest.mark.parametrize("most", [visibility.RASTER_BYTES, 0])
def test_rays_match_plain_loops(spark, most):
    """The same with the raster as an array and as a table."""
    z = rough(1, (25, 31))
    g = frame(spark, z)
    pairs = g.select(F.lit(12).alias("orow"), F.lit(7).alias("ocol"), F.col("row").alias("trow"), F.col("col").alias("tcol"), F.col("z").alias("ground"))
    req = visibility.required_by_rays(pairs, ["trow", "tcol", "ground"], g, *z.shape, F.lit(3.0), F.col("ground"), most=most).collect()
    want = {(r, c): plain_required(z, 12, 7, 3.0, r, c) for r in range(25) for c in range(31) if (r, c) != (12, 7)}
    assert {(x.trow, x.tcol): x.required for x in req} == pytest.approx(want, abs=1e-6)
    seen = visibility.sight(pairs, ["trow", "tcol", "ground"], g, *z.shape, F.lit(3.0), F.col("ground") + 2.0, most=most).collect()
    assert {(x.trow, x.tcol): x.visible for x in seen} == {k: v <= 2.0 for k, v in want.items()}


def test_sweep_agrees_with_rays_on_rough_ground():
    """A sweep interpolates horizons, so it is not the same, but nearly."""
    z = rough(2, (70, 60), 4.0)
    same = total = 0
    for row, col in ((35, 30), (0, 0), (69, 20), (10, 59)):
        need = visibility.sweep(z, row, col, z[row, col] + 2.0, RES)
        for r in range(0, 70, 2):
            for c in range(0, 60, 2):
                if (r, c) != (row, col):
                    total += 1
                    same += (need[r, c] <= 2.0) == (plain_required(z, row, col, z[row, col] + 2.0, r, c) <= 2.0)
    assert same / total > 0.93


def test_cells_without_height_hide_nothing():
    z = np.zeros((41, 41))
    z[20, 24] = 30.0
    clear = visibility.sweep(z, 20, 20, 0.1, RES)
    z[18, 22] = z[20, 23] = z[5, 5] = np.nan
    got = visibility.sweep(z, 20, 20, 0.1, RES)
    gone = np.isnan(z)
    assert (got[gone] == visibility.NO_DATA).all() and np.isfinite(got).all()
    assert clear[20, 30] > 50 and got[20, 30] > 50 and (got[~gone] >= 0).all()
    assert (got[~gone] <= clear[~gone] + 1e-9).all()


def test_required_heights_mark_range_and_gaps(spark):
    z = np.zeros((12, 9))
    z[3, 3] = np.nan
    got = visibility.required_heights(spark.createDataFrame([(5, 6, 4)], "pt_id long, row int, col int"), frame(spark, z), 0.0, reach=30.0, want=spark.range(108).selectExpr("int(id / 9) AS row", "int(id % 9) AS col")).collect()
    at = {(x.row, x.col): x.required for x in got}
    assert at[0, 0] == visibility.OUT_OF_RANGE and at[6, 5] == 0 and at[6, 4] == 0 and (3, 3) not in at or at[3, 3] == visibility.NO_DATA


def test_tiles_give_what_the_whole_raster_gives(spark):
    """Waves from every tile, over gaps, with and without a reach."""
    z = rough(3, (90, 110))
    z[40:44, 50:60] = np.nan
    pts = [(i, r, c) for i, (r, c) in enumerate((r, c) for r in range(3, 90, 17) for c in range(2, 110, 23) if not np.isnan(z[r, c]))]
    points = spark.createDataFrame(pts, "pt_id long, row int, col int")
    mask = frame(spark, z).where("row % 2 = 0").select("row", "col")
    eyes = {"2m": 2.0, "8m": 8.0}
    key = lambda x: (x.row, x.col)
    for reach in (200.0, None):
        whole, tiled = (sorted(visibility.summed_views(points, frame(spark, z), 0.0, eyes, reach=reach, mask=mask, tile=t, together=n).collect(), key=key) for t, n in ((2048, 99), (33, 2)))
        assert len(whole) == len(tiled) == 45 * 110 and any(x.area_2m for x in whole) and any(not x.area_8m for x in whole)
        for x, y in zip(whole, tiled):
            assert tuple(x) == pytest.approx(tuple(y), abs=1e-9)


def test_windows_hand_on_their_horizons():
    """Windows swept in turn, each from its neighbours' lines, give exactly what
    a sweep over one array gives."""
    z = rough(6, (61, 75))
    z[20:23, 30:36] = np.nan
    for row, col in ((30, 40), (0, 0), (60, 74), (12, 70), (19, 19)):
        want, t = visibility.sweep(z, row, col, 3.0, RES), 20
        got, lines = np.full(z.shape, visibility.NO_DATA), {}
        tiles = sorted(((r, c) for r in range(0, 61, t) for c in range(0, 75, t)), key=lambda k: abs(k[0] // t - row // t) + abs(k[1] // t - col // t))
        for r, c in tiles:
            own = z[r : r + t, c : c + t]
            frame_ = {}
            for side, (dr, dc), other in (("above", (-t, 0), "below"), ("below", (t, 0), "above"), ("left", (0, -t), "right"), ("right", (0, t), "left")):
                k = (r + dr, c + dc)
                if k in lines and abs(k[0] // t - row // t) + abs(k[1] // t - col // t) < abs(r // t - row // t) + abs(c // t - col // t):
                    frame_[side] = lines[k][other]
            cells, req, _, lines[r, c] = visibility.sweep_window(visibility.Ground(own), row - r, col - c, 3.0, RES, frame_)
            part = np.full(own.size, visibility.NO_DATA)
            part[cells] = req
            got[r : r + t, c : c + t] = part.reshape(own.shape)
        assert (got == want).all()


def test_forward_and_backward_views_agree(spark):
    """An observer sees a point if the point's sweep needs no more than the eye."""
    z = rough(4, (50, 40), 3.0)
    obs = [(0, 5, 5, 2.0), (1, 30, 22, 8.0)]
    pts = [(i, r, c) for i, (r, c) in enumerate((r, c) for r in range(1, 50, 6) for c in range(1, 40, 6))]
    got = visibility.forward_views(spark.createDataFrame(obs, "obs_id long, row int, col int, eye double"), spark.createDataFrame(pts, "pt_id long, row int, col int"), frame(spark, z), tile=17).collect()
    assert len(got) == len(obs) * len(pts)
    same = sum(x.visible == (visibility.sweep(z, pts[x.pt_id][1], pts[x.pt_id][2], z[pts[x.pt_id][1:]] + visibility.TARGET_HEIGHT, RES)[obs[x.obs_id][1:3]] <= obs[x.obs_id][3]) for x in got)
    assert same / len(got) > 0.9


def test_rasters_are_gathered_up_to_their_bound(spark, monkeypatch):
    monkeypatch.setattr(visibility, "RASTER_BYTES", 100)
    with pytest.raises(ValueError, match="not gathered"):
        visibility.raster(frame(spark, np.zeros((5, 5))), 5, 5)


@pytest.mark.parametrize("round_", [False, True])
def test_dilation_and_distances_match_plain_loops(spark, round_):
    r = random.Random(12)
    for n, steps in ((1, 3), (25, 4), (60, 0), (9, 40)):
        given = [(r.randrange(22), r.randrange(30)) for _ in range(n)] + [(0, 0)]
        cells = spark.createDataFrame(given, "row int, col int")
        off = (lambda a, b: (a * a + b * b) ** 0.5) if round_ else (lambda a, b: abs(a) + abs(b))
        far = {(i, j): min(off(i - a, j - b) for a, b in given) for i in range(22) for j in range(30)}
        got = [tuple(x) for x in grid.dilate(cells, steps, 22, 30, round_).select("row", "col").collect()]
        assert len(got) == len(set(got)) and set(got) == {k for k, v in far.items() if v <= steps}
        if round_:
            assert {(x.row, x.col): x.distance for x in grid.distances(cells, 22, 30).collect()} == pytest.approx(far)
    none = spark.createDataFrame([], "row int, col int")
    assert grid.dilate(none, 3, 22, 30).count() == grid.distances(none, 22, 30).count() == 0


def test_gaps_of_weight_zero_do_not_count(spark):
    g = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, None), (1, 1, None)], "row int, col int, z double")
    p = spark.createDataFrame([(1, 0.0, 0.5), (2, 0.5, 0.5), (3, 0.0, 1.0)], "id int, r double, c double")
    got = {x.id: x.z for x in grid.bilinear(grid.corners(p, F.col("r"), F.col("c"), 2, 2), ["id"], g).collect()}
    assert got == {1: 2.0, 2: None, 3: 3.0}


def test_polygon_of_many_edges(spark):
    """Inner tiles are decided whole, the others by the edges of their band."""
    n = 400
    at = [(2000 + (900 + 200 * math.cos(7 * a)) * math.cos(a), 2000 + (900 + 200 * math.cos(7 * a)) * math.sin(a)) for a in (2 * math.pi * i / n for i in range(n))]
    edges = [(1, *at[i], *at[(i + 1) % n]) for i in range(n)] + [(2, 1900.0, 1900.0, 2100.0, 1900.0), (2, 2100.0, 1900.0, 2000.0, 2100.0), (2, 2000.0, 2100.0, 1900.0, 1900.0)]
    r = random.Random(3)
    pts = [(i, r.uniform(700, 3300), r.uniform(700, 3300)) for i in range(1500)]

    def inside(poly, x, y):
        return sum((a[2] > y) != (a[4] > y) and x < (a[3] - a[1]) * (y - a[2]) / (a[4] - a[2]) + a[1] for a in edges if a[0] == poly) % 2 == 1

    e = spark.createDataFrame(edges, "poly int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame(pts, "id long, x double, y double")
    want = {(i, k) for i, x, y in pts for k in (1, 2) if inside(k, x, y)}
    for cell in (100.0, 333.0, 1e5):
        assert {(x.id, x.poly) for x in vector.contains(p, e, cell=cell).collect()} == want

    def away(x, y):
        out = []
        for _, x1, y1, x2, y2 in edges:
            dx, dy = x2 - x1, y2 - y1
            t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
            out.append(math.hypot(x - x1 - t * dx, y - y1 - t * dy))
        return min(out)

    ins = {i for i, _ in want}
    assert {x.id for x in vector.within(p, e, 120.0).collect()} == {i for i, x, y in pts if i in ins or away(x, y) <= 120}
    assert {x.id for x in vector.within(p, e, -60.0).collect()} == {i for i, x, y in pts if i in ins and away(x, y) > 60}


@pytest.mark.parametrize("per_part, most", [(64, 200_000), (3, 200_000), (3, 7)])
def test_nearest_nodes_of_far_points(spark, monkeypatch, per_part, most):
    """Whatever the parts; ties go to the lowest id, a third of all nodes lie in
    one place, and far clusters are found."""
    monkeypatch.setattr(space.split, "__defaults__", (per_part, most))
    monkeypatch.setattr(space.nearest_items, "__defaults__", (per_part,))
    monkeypatch.setattr(space, "SHARE", 9)
    r = random.Random(13)
    nodes = [(i, float(r.randrange(0, 500)), float(r.randrange(0, 500))) for i in range(700)] + [(900 + i, 9e4, 10.0 * i) for i in range(5)] + [(2000 - i, 77.0, 77.0) for i in range(300)]
    pts = [(i, r.uniform(-1, 1) * 10 ** r.randrange(1, 6), r.uniform(-1, 1) * 10 ** r.randrange(1, 6)) for i in range(80)] + [(99, 250.0, -3000.0)] + [(i, 77.0, 78.0) for i in range(100, 140)]
    want = {i: min(((x - a) * (x - a) + (y - b) * (y - b), n) for n, a, b in nodes) for i, x, y in pts}
    got = vector.nearest(spark.createDataFrame([*pts, (7000, None, 1.0)], "id long, x double, y double"), spark.createDataFrame(nodes, "id long, x double, y double"))
    assert {x.id: (x.d2, x.node) for x in got.collect()} == want


def test_nearest_without_nodes_or_points(spark):
    some = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert vector.nearest(some, some.limit(0)).count() == vector.nearest(some.limit(0), some).count() == 0
    assert [tuple(x) for x in vector.nearest(some, some).collect()] == [(1, 1, 0.0)]


def ways_frame(spark, rows):
    return spark.createDataFrame(rows, "g int, way array<struct<x:double,y:double>>")


def test_ways_that_do_not_close_are_told_apart(spark):
    ways = ways_frame(spark, [(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), (1, [(5.0, 5.0), (6.0, 6.0)])])
    got = {(min(r.ring, 0), r.pos) for r in planar.polygonise(ways, "g").collect()}
    assert got == {(0, 0), (0, 1), (0, 2), (0, 3), (-1, 0), (-1, 1)}


def test_rings_at_branches_crossings_and_in_holes(spark):
    """A spur before a ring's second half, diagonals that cross, a bridge between
    rings, and a ring inside another: areas of faces, holes negative."""
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    ways = [(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]), (1, [(4.0, 4.0), (6.0, 6.0)]), (1, [(4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]), (1, box(1.0, 1.0, 1.0))]
    ways += [(2, [(0.0, 0.0), (4.0, 4.0)]), (2, [(0.0, 4.0), (4.0, 0.0)]), (2, box(0.0, 0.0, 4.0))]
    ways += [(3, box(0.0, 0.0, 2.0)), (3, [(2.0, 1.0), (5.0, 1.0)]), (3, box(5.0, 0.0, 2.0)), (None, box(0.0, 0.0, 1.0)), (4, [])]
    out = planar.polygonise(ways_frame(spark, ways), "g").collect()
    rings = {}
    for r in out:
        rings.setdefault((r.g, r.ring, r.hole), {})[r.pos] = (r.x, r.y)
    area = lambda v: sum(v[i][0] * v[i + 1][1] - v[i + 1][0] * v[i][1] for i in range(len(v) - 1)) / 2
    got = sorted((str(g), area(v), hole is not None) for (g, ring, hole), v in rings.items() if ring >= 0)
    assert got == sorted([("1", 16.0, False), ("1", 1.0, False), ("1", -1.0, True), *[("2", 4.0, False)] * 4, *[("3", 4.0, False)] * 2, ("None", 1.0, False)])
    assert {(r.g, r.x, r.y) for r in out if r.ring == -1} == {(1, 4.0, 4.0), (1, 6.0, 6.0), (3, 2.0, 1.0), (3, 5.0, 1.0)}
    assert planar.polygonise(ways_frame(spark, []), "g").count() == 0


def test_thinned_polygons_share_their_borders(spark):
    """Zones of a lattice with ragged borders, one of them an island: the area
    stays whole, every inner edge has two owners, and nothing crosses."""
    r = random.Random(3)
    n, zone = 24, {}
    for i in range(n):
        cutoff = n // 2 + r.randrange(-2, 3)
        for j in range(n):
            zone[i, j] = 1 if j < cutoff else 2
    for i in range(n // 2 + r.randrange(-1, 2), n):
        for j in range(n):
            zone[i, j] += 2
    zone |= {(i, j): 9 for i in range(3, 8) for j in range(2, 6)} | {(20, 2): 7}
    rows = []
    for (i, j), z in zone.items():
        for a, b, di, dj in (((j, i), (j + 1, i), -1, 0), ((j + 1, i), (j + 1, i + 1), 0, 1), ((j + 1, i + 1), (j, i + 1), 1, 0), ((j, i + 1), (j, i), 0, -1)):
            if zone.get((i + di, j + dj)) != z:
                rows.append((z, *map(float, a), *map(float, b)))
    edge = spark.createDataFrame(rows, "poly int, x1 double, y1 double, x2 double, y2 double")
    got = planar.thin(edge, 1.6).collect()
    owners = {}
    for e in got:
        owners.setdefault((e.x1, e.y1, e.x2, e.y2), []).append(e.poly)
    outer = lambda k: k[0] == k[2] in (0, n) or k[1] == k[3] in (0, n)
    assert all(len(v) == (1 if outer(k) else 2) for k, v in owners.items()) and len(got) < len(rows) / 3
    inside = lambda p, x, y: sum((e.y1 > y) != (e.y2 > y) and x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1 for e in got if e.poly == p) % 2
    for _ in range(400):
        x, y = r.uniform(0, n), r.uniform(0, n)
        assert sum(inside(p, x, y) for p in set(zone.values())) == 1
    assert sum(e.poly == 7 for e in got) == 4  # a ring keeps its points
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    ks = list(owners)
    for m, s in enumerate(ks):
        for t in ks[:m]:
            a, b, c, d = s[:2], s[2:], t[:2], t[2:]
            assert not (side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0)


def squares(spark, rows):
    """Edge table of boxes (poly, x, y, width, height)."""
    out = []
    for p, x, y, w, h in rows:
        c = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
        out += [(p, *map(float, (*a, *b))) for a, b in zip(c, c[1:])]
    return spark.createDataFrame(out, "poly int, x1 double, y1 double, x2 double, y2 double")


def test_overlays_match_cells(spark):
    """Random boxes on a lattice, shared and repeated edges too, by unit cells."""
    r = random.Random(8)
    boxes = lambda n: [(i, r.randrange(12), r.randrange(12), r.randrange(1, 6), r.randrange(1, 6)) for i in range(n)]
    a, b = boxes(9), boxes(6)
    a.append((50, *a[0][1:]))
    cells = lambda rows: {(i, j) for _, x, y, w, h in rows for i in range(x, x + w) for j in range(y, y + h)}
    A, B = cells(a), cells(b)
    for how, want in (("union", A | B), ("difference", A - B), ("intersection", A & B)):
        rings = planar.overlay(squares(spark, a), squares(spark, b), how, cell=5.0)
        got = [x.area for x in planar.ring_areas(rings).collect()]
        assert sum(got) == len(want), how
    assert sum(x.area for x in planar.ring_areas(planar.overlay(squares(spark, a), None, "union")).collect()) == len(A)
    assert planar.overlay(squares(spark, a), squares(spark, a), "difference").count() == 0


def test_buffers_hold_what_is_within(spark):
    e = spark.createDataFrame([(1, 0.0, 0.0, 40.0, 7.0), (1, 40.0, 7.0, 33.0, 51.0), (1, 33.0, 51.0, -9.0, 22.0), (1, -9.0, 22.0, 0.0, 0.0)], "poly int, x1 double, y1 double, x2 double, y2 double")
    r = random.Random(2)
    p = spark.createDataFrame([(i, r.uniform(-25, 60), r.uniform(-25, 70)) for i in range(600)], "id long, x double, y double")
    for d in (8.0, -6.0):
        drawn = planar.buffer(e, d, 32).select(F.col("g").alias("poly"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("ax").alias("x2"), F.col("ay").alias("y2"))
        assert {x.id for x in vector.contains(p, drawn, cell=20.0).collect()} == {x.id for x in vector.within(p, e, d, cell=20.0).collect()}


def test_regions_and_rounds_find_the_same_paths(spark):
    """Equal to a heap search on the whole graph, for any regions."""
    import heapq

    r = random.Random(9)
    place = {i: (r.uniform(0, 100), r.uniform(0, 100)) for i in range(160)}
    near = lambda i: sorted(place, key=lambda j: (place[i][0] - place[j][0]) ** 2 + (place[i][1] - place[j][1]) ** 2)[1:5]
    rows = [(i, j, float(r.randrange(1, 40))) for i in place for j in near(i)] + [(i, r.randrange(160), 99.0) for i in range(0, 160, 9)]
    starts = [("a", 3), ("a", 3), ("a", 70), ("b", 155), ("c", 999)]
    want = {}
    for d in "abc":
        heap, best = [(0.0, n) for k, n in starts if k == d], {}
        while heap:
            t, n = heapq.heappop(heap)
            if n not in best:
                best[n] = t
                for i, j, w in rows:
                    if j == n and i != j:
                        heapq.heappush(heap, (t + w, i))
        want |= {(d, n): t for n, t in best.items()}
    edges, sources = spark.createDataFrame(rows, "src long, dst long, travel_s double"), spark.createDataFrame(starts, "dest string, node long")
    at = spark.createDataFrame([(i, *p) for i, p in place.items() if i != 17], "id long, x double, y double")
    for args in ({}, {"per_region": 1}, {"at": at, "per_region": 20}):
        got = {(x.dest, x.node): x.seconds for x in routing.shortest(edges, sources, **args).collect()}
        assert got == want, args


def test_chains_become_one_edge(spark):
    """One-way and two-way chains, a loop, rings without a crossing, parallel
    roads; compared with a walk from node to node."""
    rows = [(1, 2, 1.0, "a"), (2, 3, 2.0, None), (3, 4, 3.0, "b")]  # one way
    rows += [(a, b, 1.0, "c") for x, y in ((4, 5), (5, 6), (6, 7)) for a, b in ((x, y), (y, x))]  # both ways
    rows += [(7, 8, 1.0, "d"), (7, 8, 5.0, "d"), (8, 9, 1.0, "d"), (9, 10, 1.0, "e"), (10, 8, 1.0, "d")]  # parallel, then a loop at 8
    rows += [(20 + i, 20 + (i + 1) % 37, 1.0, "r") for i in range(37)] + [(a, b, 1.0, "s") for i in range(5) for a, b in ((60 + i, 60 + (i + 1) % 5), (60 + (i + 1) % 5, 60 + i))]
    rows += [(70, 70, 2.0, "t")]
    out = routing.simplify(spark.createDataFrame(rows, "src long, dst long, length_m double, highway string"), ["length_m"], ["highway"])
    got = sorted((x.src, x.dst, x.length_m, "".join(x.highway), x.parts) for x in out.collect())
    assert got == sorted([
        (1, 4, 6.0, "ab", 3), (4, 7, 3.0, "c", 3), (7, 4, 3.0, "c", 3), (7, 8, 1.0, "d", 1), (7, 8, 5.0, "d", 1), (8, 8, 3.0, "de", 3),
        (20, 20, 37.0, "r", 37), (60, 60, 5.0, "s", 5), (60, 60, 5.0, "s", 5), (70, 70, 2.0, "t", 1),
    ])
    none = spark.createDataFrame([], "src long, dst long, length_m double")
    assert routing.simplify(none, ["length_m"]).count() == 0


@pytest.mark.parametrize("lengths", [[1], [2, 2, 3], [64, 65, 1, 130]])
def test_links_are_ranked(spark, lengths):
    rows, want, at = [], set(), 0
    for k, n in enumerate(lengths):
        ring = k % 2 == 1
        for i in range(n):
            rows.append((at + i, at + (i - 1) % n if ring or i else None, at + i))
            want.add((at + i, at, i + 1, ring))
        at += n
    random.Random(1).shuffle(rows)
    got = chains.ranked(spark.createDataFrame(rows, "id long, prev long, node long"))
    assert {tuple(x) for x in got.collect()} == want


def test_largest_component_and_clip(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(200, 200)], "src long, dst long")
    got = routing.largest_component(edges)
    assert {x.src for x in got.collect()} == set(range(100, 160))
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(201)], "id long, x double, y double")
    assert {x.src for x in routing.clip(nodes, edges, (10.0, 0.0, 12.0, 0.0)).collect()} == {9, 10, 11, 12}


def test_quantiles_match_numpy(spark):
    r = random.Random(5)
    rows = [(k, float(r.randrange(50))) for k in ("a", "b") for _ in range(301)] + [("one", 4.0)]
    df = spark.createDataFrame(rows, "metric string, v double")
    for q in (0.0, 0.5, 0.9, 0.98, 1.0):
        got = {x.metric: x.q for x in ranking.quantiles(df, q).collect()}
        assert got == pytest.approx({k: float(np.quantile([v for m, v in rows if m == k], q)) for k in ("a", "b", "one")})
    assert {x.metric: x.upper_median for x in ranking.upper_medians(df).collect()} == {k: sorted(v for m, v in rows if m == k)[sum(m == k for m, _ in rows) // 2] for k in ("a", "b", "one")}


def test_frequent_values_keep_their_percentile(spark, monkeypatch):
    monkeypatch.setattr(ranking, "OFTEN", 4)
    vals = [0.0] * 300 + [float(i) for i in range(1, 101)]
    df = spark.createDataFrame([(i, "m", v) for i, v in enumerate(vals)], "id long, metric string, v double")
    got = {x.id: x.p for x in ranking.midpoint_percentiles(df).collect()}
    assert len(got) == 400 and got[0] == got[299] == 299 / 2 / 399 and got[399] == 1.0 and got[300] == 300 / 399


def test_usable_land_needs_a_slope_off_the_lake(spark):
    cells = spark.createDataFrame([(1, 5.0, False), (1, 20.0, False), (1, float("nan"), False), (1, None, False), (1, 1.0, True), (None, 1.0, False)], "z int, slope double, lake boolean")
    got = zonal.usable(cells, spark.createDataFrame([(1,), (2,)], "z int"), "z", "slope", lake=F.col("lake")).orderBy("z").collect()
    assert [tuple(x) for x in got] == [(1, 0.02, 50.0), (2, 0.0, 0.0)]
    scale = spark.createDataFrame([("a", "2m", -9999.0), ("a", "2m", 4.0), ("b", "2m", -9999.0)], "m string, e string, v double")
    assert {x.m: x.vmax for x in zonal.colour_scale(scale, "m", "e", "v").collect()} == {"a": 4.0, "b": 1.0}


def test_colours(spark):
    own = [(i, 255 - i, 7) for i in range(256)]
    df = spark.createDataFrame([(-1.0,), (0.0,), (2.5,), (10.0,), (99.0,)], "z double")
    got = [tuple(x)[1:] for x in render.heat(df, "z", F.lit(10.0), own).collect()]
    assert got == [(0, 255, 7, 0), (0, 255, 7, 0), (128, 127, 7, 180), (255, 0, 7, 255), (255, 0, 7, 255)]
    assert [render.ramp()[i] for i in render._AT] == list(render.LEGEND)


def test_packed_heights_are_read_singly(spark):
    g = spark.createDataFrame([(r, c, 700.0 + r + c / 10) for r in range(4) for c in range(90)], "row int, col int, z double")
    asked = spark.createDataFrame([(r, c) for r in (1, 3) for c in (0, 1, 2, 37, 38, 88, 89)], "row int, col int")
    got = {(x.row, x.col): x.z for x in render.heights_at(render.pack_rows(g), asked).collect()}
    assert got == pytest.approx({(r, c): 700.0 + r + c / 10 for r in (1, 3) for c in (0, 1, 2, 37, 38, 88, 89)})


class Service(BaseHTTPRequestHandler):
    asked: list[dict] = []

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Service.asked.append(q)
        rows = [i for i in range(30) if "size > 10" not in q["where"] or i > 10]
        answer = {"count": len(rows)}
        if "resultOffset" in q:
            at = int(q["resultOffset"])
            answer = {"features": [{"properties": {"OBJECTID": i, "size": i}} for i in rows[at : at + int(q["resultRecordCount"])]]}
        data = json.dumps(answer).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


def test_filters_go_to_the_service(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        paged.register(spark)
        df = spark.read.format("ridgeline_pages").schema("OBJECTID long, size int").option("url", f"http://127.0.0.1:{server.server_port}/q").option("page", 7).option("wait", 0).option("box", "-80,39,-79,40").load()
        assert sorted(x.OBJECTID for x in df.where("size > 10").collect()) == list(range(11, 30))
    finally:
        server.shutdown()
    assert all(q["geometry"] == "-80,39,-79,40" and q["where"] == "1=1 AND size > 10" for q in Service.asked) and len(Service.asked) == 4


class Files(BaseHTTPRequestHandler):
    failures = 0
    posted: list[str] = []

    def answer(self, data):
        if Files.failures > 0:
            Files.failures -= 1
            self.send_response(503)
            self.end_headers()
            return
        self.send_response(200)
        self.send_header("Content-Length", str(len(data) + (10 if "broken" in self.path else 0)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        self.answer(b"tile" * 1000)

    def do_POST(self):
        Files.posted.append(self.rfile.read(int(self.headers["Content-Length"])).decode())
        way = {"type": "way", "role": "outer", "geometry": [{"lon": 1.0, "lat": 2.0}, {"lon": 3.0, "lat": 4.0}]}
        self.answer(json.dumps({"elements": [{"type": "node"}, {"type": "relation", "members": [way]}]}).encode())

    def log_message(self, *args):
        pass


def test_downloads_are_whole_or_missing(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Files)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        Files.failures = 2
        fetch.download(spark, f"{url}/t", f"file://{tmp_path}/t.bin", wait=0)
        assert (tmp_path / "t.bin").read_bytes() == b"tile" * 1000
        with pytest.raises(Exception):
            fetch.download(spark, f"{url}/broken", f"file://{tmp_path}/b.bin", wait=0)
        Files.failures = 9
        with pytest.raises(OSError):
            fetch.download(spark, f"{url}/u", f"file://{tmp_path}/u.bin", wait=0)
        assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t.bin"]
        fetch.download(spark, f"{url}/t", f"file://{tmp_path}/t.bin", wait=0)  # it is there
        Files.failures = 0
        for _ in range(2):
            ways = fetch.fetch_relation(spark, f"{url}/api", 7, f"file://{tmp_path}/r.json", wait=0).collect()
            assert [(x.outer, len(x.way)) for x in ways] == [(True, 2)]
        assert len(Files.posted) == 1 and "rel%287%29" in Files.posted[0]
    finally:
        server.shutdown()


def test_files_are_published_whole(spark, tmp_path):
    path = f"file://{tmp_path}/a/b.txt"
    for text in (b"one", b"two and more", b""):
        tables.publish(spark, text, path)
        assert (tmp_path / "a/b.txt").read_bytes() == text
    assert [p.name for p in (tmp_path / "a").iterdir() if "part" in p.name and not p.name.endswith(".crc")] == []
    (tmp_path / "d").mkdir()
    with pytest.raises(OSError, match="folder"):
        tables.publish(spark, b"x", f"file://{tmp_path}/d")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tables, "_put", lambda *a: (_ for _ in ()).throw(OSError("no rename")))
        tables_before = b"as it was"
        (tmp_path / "a/b.txt").write_bytes(tables_before)
        (tmp_path / "a/.b.txt.crc").unlink(missing_ok=True)
        with pytest.raises(OSError, match="no rename"):
            tables.publish(spark, b"new", path)
        assert (tmp_path / "a/b.txt").read_bytes() == tables_before
    assert sorted(p.name for p in tmp_path.rglob("*part*") if not p.name.endswith(".crc")) == []
    with pytest.raises(ValueError, match="one row"):
        tables.write_metadata(spark.range(2), f"file://{tmp_path}/m.json")


def test_empty_and_too_many_points(spark, tmp_path, monkeypatch):
    none = spark.createDataFrame([], "pt_id long, x double, y double")
    tables.write_points(none, f"file://{tmp_path}/p.npz")
    assert tables.read_points(spark, f"file://{tmp_path}/p.npz").count() == 0
    monkeypatch.setattr(tables, "ARRAY_POINTS", 1)
    with pytest.raises(ValueError, match="too many"):
        tables.write_points(spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], none.schema), f"file://{tmp_path}/q.npz")


def test_messages(spark):
    none = spark.createDataFrame([], "id int")
    assert ranking.message(none, {}).first()[0].startswith("No metric")
    assert "listing" in ranking.message(none, {"asking": 1}).first()[0] and "listing" not in ranking.message(none, {"shore": 1}).first()[0]
    assert ranking.message(spark.range(3), {"shore": 1}).count() == 0
