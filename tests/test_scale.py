"""What larger tables showed: borders, reach of searches, sizes of results."""

import random

import numpy as np
from pyspark.sql import functions as F

from ridgeline.operators import chains, planar, routing, vector, visibility
from ridgeline.streaming import listings


def box(spark, x1, y1, x2, y2, poly=1):
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
    return spark.createDataFrame([(poly, *map(float, (*p, *q))) for p, q in zip(corners, corners[1:] + corners[:1])], "poly int, x1 double, y1 double, x2 double, y2 double")


def test_edges_on_a_border_touch_the_cells_of_both_sides(spark):
    got = vector.touched(box(spark, 500, 260, 740, 490), 250.0)
    assert {(r.row, r.col) for r in got.collect()} == {(1, 1), (1, 2)}
    got = vector.touched(box(spark, 510, 250, 740, 490), 250.0)
    assert {(r.row, r.col) for r in got.collect()} == {(0, 2), (1, 2)}


def test_rays_of_many_rows_and_hidden_ones_end_early(spark):
    """Rows beyond 46,340, whose squared distance is no integer; both forms of
    the march agree, and of what lies beyond the limit only that is known."""
    rows = [(0, 0, 60_000, 0), (0, 0, 30, 0), (0, 1, 25, 1), (0, 0, 7, 1), (0, 1, 90, 0)]
    pairs = spark.createDataFrame(rows, "orow int, ocol int, trow int, tcol int")
    grid = spark.range(0, 60_001).select(F.col("id").cast("int").alias("row"), F.explode(F.array(F.lit(0), F.lit(1))).alias("col"), (F.col("id") % 7 * 2.5).alias("z"))
    keys = ["orow", "ocol", "trow", "tcol"]
    look = lambda some, m: sorted(visibility.sight(some, keys, grid, 60_001, 2, F.lit(30.0), F.lit(15.0), most=m).collect())
    got = look(pairs, visibility.RASTER_BYTES)
    assert {r.trow: r.visible for r in got}[60_000] is False and any(r.visible for r in got)
    near = pairs.where("trow < 100")
    assert look(near, 0) == look(near, visibility.RASTER_BYTES) == [r for r in got if r.trow < 100]
    whole, part = ({tuple(r[:4]): r.required for r in visibility.required_by_rays(pairs, keys, grid, 60_001, 2, F.lit(30.0), F.lit(0.0), limit=m).collect()} for m in (float("inf"), 8.0))
    assert len(whole) == 5 and all(part[k] == v if v <= 8 else 8 < part[k] <= v for k, v in whole.items())


def test_sweeps_end_where_nothing_is_seen(spark, monkeypatch):
    """Thirty tiles in a row behind a wall; a sweep of them all has thirty waves."""
    z = np.random.default_rng(5).normal(0, 2, (120, 4))
    z[20] += 60
    z[4] += 60
    grid = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(120) for j in range(4)], "row int, col int, z double")
    calls, cut = [], visibility.cut
    monkeypatch.setattr(visibility, "cut", lambda df: calls.append(1) or cut(df))
    obs = spark.createDataFrame([(0, 12, 1, 2.0)], "obs_id long, row int, col int, eye double")
    targets = grid.select((F.col("row").cast("long") * 4 + F.col("col")).alias("pt_id"), "row", "col")
    got = {r.pt_id: r.visible for r in visibility.forward_views(obs, targets, grid, tile=4).collect()}
    need = visibility.sweep(z, 12, 1, z[12, 1] + 2.0, 10.0).ravel()
    assert got == {i: bool(0 <= v <= visibility.TARGET_HEIGHT) for i, v in enumerate(need)} and any(got.values())
    assert len(calls) < 30


def test_counts_of_crowded_tiles_shared_out(spark, monkeypatch):
    r = np.random.default_rng(3)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate([*r.integers(0, 60, (400, 2)), *[(7, 7)] * 300])]
    x, y = (np.array([p[k] for p in pts]) for k in (1, 2))
    want = (np.subtract.outer(x, x) ** 2 + np.subtract.outer(y, y) ** 2 < 400).sum(axis=1)
    assert (vector._counted(x, y, x, y, 20.0) == want).all()
    monkeypatch.setattr(vector, "CROWD", 100)
    got = vector.count_within(spark.createDataFrame(pts, "id long, x double, y double"), 20.0).collect()
    assert {r.id: r.n for r in got} == dict(enumerate(want.tolist()))


def test_long_edges_are_searched_by_their_stretches(spark, monkeypatch):
    """A point meets few of many long edges; a tile inside a polygon is enough
    for its points."""
    r = np.random.default_rng(4)
    lines = [(i, *map(float, (*a, *(a + d)))) for i, (a, d) in enumerate(zip(r.uniform(0, 1000, (600, 2)), r.uniform(-300, 300, (600, 2))))]
    edge = spark.createDataFrame(lines, "poly int, x1 double, y1 double, x2 double, y2 double")
    pts = [(i, *map(float, p)) for i, p in enumerate(r.uniform(0, 1000, (200, 2)))]
    points = spark.createDataFrame(pts, "id long, x double, y double")
    e = np.array(lines)[:, 1:]
    d = e[:, 2:] - e[:, :2]
    def least(p):
        t = np.clip(((p - e[:, :2]) * d).sum(axis=1) / (d * d).sum(axis=1), 0, 1)
        return np.hypot(*(e[:, :2] + t[:, None] * d - p).T).min()
    got = {r.id: r.distance for r in vector.boundary_distance(points, edge).collect()}
    assert all(abs(got[i] - least(np.array(p))) < 1e-9 for i, *p in pts) and len(got) == 200
    squares = box(spark, 0, 0, 800, 800).union(box(spark, 100, 100, 900, 900, 2))
    met = []
    inside = vector._Tiles.inside
    monkeypatch.setattr(vector._Tiles, "inside", lambda self, at, keys, without=None: (met.append(at.count()) if "id" in keys else None) or inside(self, at, keys, without))
    got = {r.id: r.inside for r in vector.inside_any(points, squares).collect()}
    assert got == {i: 0 < x < 800 and 0 < y < 800 or 100 < x < 900 and 100 < y < 900 for i, x, y in pts}
    assert met[0] < 300  # of 400 pairs


def test_streams_store_listings_and_not_pairs(spark, monkeypatch):
    """Forty listings and thirty parcels of one address; arrays of eight."""
    said = spark.createDataFrame([*[("1 Main St.", f"${i}", f"u{i}") for i in range(40)], ("9 Elm", "", "v"), ("", "$1", "w")], "address string, price string, url string")
    parcels = spark.createDataFrame([*[(i, "1 MAIN ST") for i in range(30)], (90, ""), (91, "2 OAK")], "id int, address string")
    monkeypatch.setattr(listings, "TOGETHER", 8)
    known = listings.known_listings(said, parcels, "address")
    assert known.count() == 40
    got = listings.listed_parcels(known, parcels, "address", "id")
    want = listings.match_listings(said, parcels, "address", "id")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() == 1200


def test_segments_on_one_line_are_cut_as_one(spark, monkeypatch):
    """Forty level and forty upright segments that overlap: two runs."""
    rows = [(0, float(i), 5.0, float(i + 9), 5.0) for i in range(40)] + [(0, 7.0, float(i), 7.0, float(i + 9)) for i in range(40)]
    segs = planar.ordered(spark.createDataFrame(rows, "g int, x1 double, y1 double, x2 double, y2 double"))
    sizes, met = [], planar._met
    monkeypatch.setattr(planar, "_met", lambda s, cell: sizes.append(s.count()) or met(s, cell))
    got = planar.noded(segs).select("x1", "y1", "x2", "y2").distinct().collect()
    assert sizes == [2]
    assert {tuple(r) for r in got} == {(float(i), 5.0, float(i + 1), 5.0) for i in range(48)} | {(7.0, float(i), 7.0, float(i + 1)) for i in range(48)}


def test_groups_meet_in_squares_of_their_own_size(spark, monkeypatch):
    """Buffers of thirty polygons in one place are drawn like that of one."""
    cells, met = [], planar._met
    monkeypatch.setattr(planar, "_met", lambda s, cell: cells.append(cell) or met(s, cell))
    lines = [(0.0, 0.0, 90.0, 7.0), (0.0, 50.0, 80.0, 3.0), (10.0, 0.0, 40.0, 60.0)]
    for n in (1, 30):
        segs = planar.ordered(spark.createDataFrame([(g, *s) for g in range(n) for s in lines], "g int, x1 double, y1 double, x2 double, y2 double"))
        assert planar.noded(segs).count() == 9 * n
    assert abs(cells[0] - cells[1]) < 1e-9
    points = spark.createDataFrame([(g, g, 5.0, 5.0) for g in range(30)], "id int, g int, x double, y double")
    edge = box(spark, 0, 0, 10, 10).drop("poly").crossJoin(spark.range(30).select(F.col("id").alias("g"), F.col("id").alias("poly")))
    assert sorted(tuple(r) for r in vector.decided(points, edge).collect()) == [(g, g) for g in range(30)]


def test_pairs_of_polygons_are_measured_in_one_task(spark, monkeypatch):
    """Triangles, some in others or crossing them, by shares of three and four;
    pairs are not shuffled."""
    r = np.random.default_rng(6)
    monkeypatch.setattr(vector, "PAIRED", (3, 4))
    at = [(p := r.uniform(0, 300, 2)) + r.uniform(-1, 1, (3, 2)) * s for s in r.choice([4, 25, 90], 40)]
    rows = [(i, *map(float, (*t[k], *t[(k + 1) % 3]))) for i, t in enumerate(at) for k in range(3)]
    edge = spark.createDataFrame(rows, "poly int, x1 double, y1 double, x2 double, y2 double")
    out = vector.polygon_distance(edge, edge, 30.0)
    above = out._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")
    assert len(above) > 1 and "Exchange" not in above[0]

    cross = lambda u, v, w: (v[0] - u[0]) * (w[1] - u[1]) - (v[1] - u[1]) * (w[0] - u[0])
    within = lambda p, t: len({cross(t[k], t[(k + 1) % 3], p) > 0 for k in range(3)}) == 1

    def away(p, u, v):
        t = np.clip((p - u) @ (v - u) / ((v - u) @ (v - u)), 0, 1)
        return np.hypot(*(p - u - t * (v - u)))

    def apart(s, t):
        sides = [(s[k], s[(k + 1) % 3], t[m], t[(m + 1) % 3]) for k in range(3) for m in range(3)]
        if within(s[0], t) or within(t[0], s) or any(cross(a, b, c) * cross(a, b, d) < 0 and cross(c, d, a) * cross(c, d, b) < 0 for a, b, c, d in sides):
            return 0.0
        return min(min(away(a, c, d), away(c, a, b)) for a, b, c, d in sides)

    want = {(i, j): d for i, s in enumerate(at) for j, t in enumerate(at) if (d := apart(s, t)) <= 30}
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(want) and all(abs(want[i, j] - d) < 1e-9 for i, j, d in got)


def test_regions_of_a_long_graph_are_compact(spark, monkeypatch):
    """A track of 300 by 4 places: regions across it, and no round for each."""
    def no(*a):
        raise AssertionError("times went round by round")

    monkeypatch.setattr(routing, "_spread", no)
    at = spark.range(1200).select("id", (F.col("id") % 4).cast("double").alias("x"), F.floor(F.col("id") / 4).cast("double").alias("y"))
    ways = [(i, j) for i in range(1200) for j in (i + 4, *([i + 1] if i % 4 < 3 else [])) if j < 1200]
    edges = spark.createDataFrame([(a, b, 1.0) for i, j in ways for a, b in ((i, j), (j, i))], "src long, dst long, travel_s double")
    out = routing.shortest(edges, spark.createDataFrame([("a", 0), ("a", 1199), ("b", 2)], "dest string, node long"), at, 60)
    got = {(r.dest, r.node): r.seconds for r in out.collect()}
    want = {("a", i): min(i % 4 + i // 4, 3 - i % 4 + 299 - i // 4) for i in range(1200)} | {("b", i): abs(i % 4 - 2) + i // 4 for i in range(1200)}
    assert got == want


def test_chains_are_joined_where_their_nodes_are(spark, monkeypatch):
    """Streets of many pieces from three crossings, both ways and round: only
    what goes on in another task is ranked, and tasks of any size agree."""
    rows = [(1000 + 50 * o + k, 1000 + 50 * o + k + 1) for o in range(40) for k in range(30)]
    rows += [(o % 3, 1000 + 50 * o) for o in range(30)] + [(1030 + 50 * o, o * 7 % 3) for o in range(30)]
    rows += [(1030 + 50 * o, 1000 + 50 * o) for o in range(30, 35)] + [(0, 1), (0, 1), (None, 0), (1000 + 50 * 39, None)]
    rows += [(b, a) for a, b in rows if a is not None and b is not None and (a // 50) % 2]
    edges = spark.createDataFrame([(a, b, float(i % 9 + 1), "abc"[i % 3]) for i, (a, b) in enumerate(rows)], "src long, dst long, length_m double, highway string").repartition(4)
    seen, ranked = [], routing.ranked
    monkeypatch.setattr(routing, "ranked", lambda links: seen.append(links.count()) or ranked(links))

    def look(size, sent):
        monkeypatch.setattr(routing, "PER_TASK", size)
        monkeypatch.setattr(routing, "MOST_SENT", sent)
        return sorted(map(str, routing.simplify(edges, ["length_m"], ["highway"]).collect()))

    got = look(1_000_000, 500_000)
    assert seen == [0]  # of some 1,900 edges
    assert look(300, 0) == look(3, 500_000) == got and seen[2] > seen[1] > 0


def test_edges_are_not_dealt_by_their_class(spark):
    edges = spark.range(4000).selectExpr("id AS src", "id + 1 AS dst", "IF(id % 2 = 0, 'path', NULL) AS highway", "IF(id % 4 = 0, 50D, NULL) AS maxspeed_kph", "100D AS length_m")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = routing.travel_times(edges)
        assert out.groupBy("highway", "speed_kph").count().collect() and "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert {(r.highway, r.speed_kph) for r in out.collect()} == {("path", 50.0), (None, 35.0)}


def test_links_are_joined_in_their_part_before_they_are_ranked(spark):
    """Chains and rings over many parts, in one and in parts that they enter
    again: as ranked link by link."""
    r = np.random.default_rng(8)
    rows, n = [], 0
    for size in (1, 1, 2, 3, 4, 4, 7, 30, 65):
        for ring in (False, True):
            for spread in (1, 4):
                ids = (r.permutation(size) + n).tolist()
                rows += [(i, ids[k - 1] if k or ring else None, float(r.integers(3)), float(i % 2), int(r.integers(spread))) for k, i in enumerate(ids)]
                n += size
    links = spark.createDataFrame(rows, "id long, prev long, u double, v double, part int")
    want = chains.ranked(links.select("id", "prev", F.struct("u", "v").alias("node")))
    assert sorted(chains.ranked_near(links).collect()) == sorted(want.collect())


def test_only_what_leaves_its_part_is_ranked(spark, monkeypatch):
    """Blocks of lines that cross and stick out, a sixth of their half-edges to a part."""
    n, seen, jumped = 12, [], chains._jumped
    monkeypatch.setattr(chains, "_jumped", lambda state: seen.append(state.count()) or jumped(state))
    monkeypatch.setattr(planar, "PER_PART", 100)
    lines = [[(-0.5, float(i)), (n - 0.5, float(i))] for i in range(n)] + [[(float(i), -0.5), (float(i), n - 0.5)] for i in range(n)]
    ways = spark.createDataFrame([(0, x) for x in lines], "g int, way array<struct<x:double,y:double>>")
    out = planar.polygonise(ways, "g")
    sizes = out.where("ring >= 0").groupBy("ring").count().collect()
    assert len(sizes) == (n - 1) ** 2 and {x["count"] for x in sizes} == {5}
    assert out.where("ring < 0").count() == 8 * n
    assert seen and max(seen) < 4 * n * (n + 1) / 2  # stretches, of so many half-edges halved


def test_lines_are_thinned_together(spark, monkeypatch):
    """As one by one, whether a line lies in one batch or goes on in the next."""
    r = np.random.default_rng(3)
    rows = [(i, k, float(x), float(y)) for i in range(40) for k, (x, y) in enumerate(r.integers(0, 9, (int(r.integers(1, 60)), 2)).cumsum(0))]

    def plain(p):
        if len(p) < 3:
            return [q[1] for q in p]
        (_, a, x, y), (_, b, u, v) = p[0], p[-1]
        n = ((u - x) ** 2 + (v - y) ** 2) ** 0.5
        d = [abs((s - x) * (v - y) - (t - y) * (u - x)) / n if n else ((s - x) ** 2 + (t - y) ** 2) ** 0.5 for _, _, s, t in p[1:-1]]
        m = 1 + d.index(max(d))
        return plain(p[: m + 1])[:-1] + plain(p[m:]) if max(d) > 4 else [a, b]

    want = sorted((i, k) for i in range(40) for k in plain([q for q in rows if q[0] == i]))
    lines = spark.createDataFrame(rows, "id long, pos int, x double, y double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for most in (1, 30, vector.POINTS):
            monkeypatch.setattr(vector, "POINTS", most)
            assert sorted((q.id, q.pos) for q in vector.simplify(lines, "id", 4.0).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_points_may_have_numbers_of_several_fields_without_nulls(spark):
    p = spark.range(4).selectExpr("struct(id AS a, id AS b) AS id", "id + 0.5D AS x", "0.5D AS y")
    assert sorted(r.id.a for r in vector.contains(p, box(spark, 1, 0, 3, 1), cell=1.0).collect()) == [1, 2]


def test_buffers_are_drawn_at_any_angle(spark):
    """Edges that nearly lie on each other, and their buffers' sides with them."""
    r = random.Random(5)
    rows = []
    for poly in range(12):
        turn = 10.0 ** -r.randrange(7, 14)
        x, y = r.uniform(0, 9000), r.uniform(0, 9000)
        v = [(x, y), (x + 300.0, y + 71.0), (x + 600.0, y + 142.0 + 600 * turn), (x + 600.0 + turn, y + 400.0), (x + 300.0, y + 400.0 + turn), (x + turn, y + 400.0)]
        rows += [(poly, *a, *b) for a, b in zip(v, v[1:] + v[:1])]
    e = spark.createDataFrame(rows, "poly int, x1 double, y1 double, x2 double, y2 double")
    for d in (150.0, -60.0):
        rings = planar.buffer(e, d)
        area = {x.g: x.area for x in planar.ring_areas(rings).groupBy("g").agg(F.sum("area").alias("area")).collect()}
        assert len(area) == 12
        for poly in area:
            own = [q[1:] for q in rows if q[0] == poly]
            size, border = sum(a * y - x * b for a, b, x, y in own) / 2, sum(((a - x) ** 2 + (b - y) ** 2) ** 0.5 for a, b, x, y in own)
            if d > 0:  # a convex polygon
                assert size + border * d + 3.13 * d * d < area[poly] < size + border * d + 3.15 * d * d
            else:
                assert size + border * d < area[poly] < size + border * d + 4 * 2 * d * d


def test_few_edges_of_two_polygons_are_compared(spark, monkeypatch):
    """Long polygons: a pair is measured once, by edges that face each other."""
    line = lambda y, n: [(float(x), y) for x in range(n)] + [(float(n), y + 1.0), (-1.0, y + 1.0)]
    rows = [(k, *p, *q) for k in range(6) for v in [line(4.0 * k, 40)] for p, q in zip(v, v[1:] + v[:1])]
    e = spark.createDataFrame(rows, "poly int, x1 double, y1 double, x2 double, y2 double")
    got = vector.polygon_distance(e, e, 20.0, once=True).collect()
    assert sorted((r.a, r.b, r.distance) for r in got) == [(a, b, 4.0 * (b - a) - 1) for a in range(6) for b in range(a + 1, 6)]
    import pyarrow as pa

    def one(n, right):
        edge = [dict(zip(("x1", "y1", "x2", "y2"), (r[1] + right, r[2], r[3] + right, r[4]))) for r in rows if r[0] == 0]
        return vector._Many(pa.Table.from_pylist([{n: 0, n + "e": edge, n + "x1": right - 1.0, n + "y1": 0.0, n + "x2": right + 40.0, n + "y2": 1.0}]), n)

    a, b, i = one("a", 0.0), one("b", 60.0), np.array([0])
    assert vector._distances(a, b, i, i).tolist() == [19.0]
    assert len(vector._facing(a, i, b, i, np.array([20.0**2]))[0]) < 5 < a.n[0]


def test_times_through_a_region_by_fewer_roads(monkeypatch):
    """Nodes that are left out one by one, by a matrix or not at all: as searched."""
    import pandas as pd

    r = np.random.default_rng(4)
    rows = {(a, b): float(r.integers(1, 50)) for a, b in r.integers(0, 90, (400, 2)).tolist() if a != b}
    roads = pd.DataFrame([(a, b, w) for (a, b), w in rows.items()], columns=["node", "next", "w"])
    asked = pd.DataFrame([(None, n, False) for n in (1, 5, 9)] + [("x", 5, False), ("x", 999, False)] + [(None, n, True) for n in (5, 40, 41, 998)], columns=["dest", "node", "leaves"])
    graph = routing._Roads(roads)
    want = {(d, n, m, t) for d, n in ((None, 1), (None, 5), (None, 9), ("x", 5), ("x", 999)) for m, t in graph.search([(0.0, n)]).items() if m in (5, 40, 41, 998)}
    for ways, dense in ((256, 4000), (4, 4000), (0, 4000), (9, 1)):
        monkeypatch.setattr(routing, "MOST_WAYS", ways)
        monkeypatch.setattr(routing, "MOST_DENSE", dense)
        assert set(routing._through(asked, roads).itertuples(index=False, name=None)) == want
    monkeypatch.setattr(routing, "MOST_WAYS", 256)
    assert len(routing._passed(roads, {1, 5, 9})) < 60


def test_a_second_sight_needs_no_join(spark):
    """The first result goes along as a column, over a raster in tasks or joined."""
    r = np.random.default_rng(6)
    g = spark.createDataFrame([(i, j, float(r.integers(0, 30))) for i in range(12) for j in range(12)], "row int, col int, z double")
    pairs = spark.createDataFrame([(o, p, t, u) for o, p in ((0, 0), (5, 7)) for t in range(12) for u in range(12)], "orow int, ocol int, trow int, tcol int")
    keys, ends = ["orow", "ocol", "trow", "tcol"], (g, 12, 12, F.lit(25.0), F.lit(15.0))
    for most in (1 << 20, 0):
        a, b = visibility.sight(pairs, keys, *ends, step=4.0, most=most), visibility.sight(pairs, keys, *ends, step=10.0, up=True, most=most)
        plain = [{tuple(x[k] for k in keys): x.visible for x in d.collect()} for d in (a, b)]
        both = visibility.sight(a.withColumnRenamed("visible", "fine"), [*keys, "fine"], *ends, step=10.0, up=True, most=most)
        got = visibility.agreement(both, "fine", "visible").first()
        assert got.pairs == len(plain[0]) == 286
        assert abs(got.percent - 100 * sum(plain[0][k] == plain[1][k] for k in plain[0]) / 286) < 1e-9
