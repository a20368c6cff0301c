"""Operators against plain computations, and the properties they must have."""

import heapq
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions import geo
from ridgeline.functions import scalar as S
from ridgeline.operators import grid, linkage, ranking, render, routing, sampling, vector, visibility, zonal
from ridgeline.plans import scoring, terrain
from ridgeline.sources import geojson, paged, tables
from ridgeline.streaming.listings import match_listings, stream_listings


def test_presets_sum_to_100_and_metrics_are_known():
    ids = {m.id for m in ranking.metrics("2m", scoring.DESTINATIONS)}
    assert len(ids) == 13 and all(sum(p.values()) == 100 and set(p) <= ids for p in ranking.PRESETS.values())


def test_scores_keep_their_properties(spark, folder):
    p = scoring.parcels(spark, folder)
    reg = ranking.metrics("2m", scoring.DESTINATIONS)
    whole = {r.parcel_idx: r.score for r in ranking.score(p, "parcel_idx", reg, ranking.PRESETS["balanced"]).collect()}
    some = ranking.score(p, "parcel_idx", reg, ranking.PRESETS["balanced"], ranking.lot_filter("vacant", min_acres=3)).collect()
    assert whole and all(0 <= s <= 100 for s in whole.values()) and all(whole[r.parcel_idx] == r.score for r in some) and len(some) < len(whole)
    low = ranking.score(p, "parcel_idx", reg, {"route_i68": 1}).select("drive_i68_min", "score").orderBy("drive_i68_min").collect()
    assert all(a.score >= b.score for a, b in zip(low, low[1:]))
    assert ranking.score(p.drop("list_price").withColumn("list_price", F.lit(None).cast("double")), "parcel_idx", reg, {"asking": 100}).count() == 0


def test_percentiles_match_bisection(spark):
    r = random.Random(1)
    rows = [(i, m, float(r.randrange(40))) for i in range(500) for m in ("a", "b")] + [(0, "one", 5.0)]
    got = ranking.midpoint_percentiles(spark.createDataFrame(rows, "id int, metric string, v double")).collect()
    for x in got:
        vals = sorted(v for _, m, v in rows if m == x.metric)
        lo, hi = sum(v < x.v for v in vals), sum(v <= x.v for v in vals) - 1
        assert x.p == (0.5 if len(vals) == 1 else (lo + hi) / 2 / (len(vals) - 1))


def test_zones_without_cells_are_zero(spark):
    v = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, -1.0)], "z int, v double")
    got = {r.z: tuple(r)[1:] for r in zonal.zonal(v, spark.createDataFrame([(1,), (2,), (3,)], "z int"), "z", {"v": "v"}).collect()}
    assert got == {1: (2, 3.0, 4.0, 3.8), 2: (1, -1.0, 0.0, -1.0), 3: (0, 0.0, 0.0, 0.0)}


def test_listings(spark):
    parcels = spark.createDataFrame([(1, "1 Main St."), (2, "1 main st"), (3, None), (4, "2 Oak")], "id int, address string")
    said = spark.createDataFrame([(0, "1 MAIN ST", "$5", "a"), (1, "1 Main, St", "", "b"), (2, "", "$9", "c"), (3, "9 Elm", "$1.50", "d")], "pos int, address string, price string, url string")
    got = {r.id: (r.list_price, r.list_url) for r in linkage.attach_listings(parcels, said, "address", "pos").collect()}
    assert got == {1: (None, "b"), 2: (None, "b"), 3: (None, None), 4: (None, None)}
    assert {r.url for r in linkage.unmatched_listings(parcels, said, "address").collect()} == {"c", "d"}
    with pytest.raises(Exception, match="row counts differ"):
        linkage.join_by_position(parcels, parcels.where("id > 1"), "id").collect()


def test_strict_prices_raise(spark):
    df = spark.createDataFrame([("1.2.3",)], "p string")
    assert df.select(S.parse_price(F.col("p"))).first()[0] is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(S.parse_price(F.col("p"), strict=True)).collect()


def test_labels(spark):
    df = spark.createDataFrame([(0.04567, 1234.5)], "a double, b double")
    got = df.select(S.millisteradians_label(F.col("a")), S.acres_label(F.col("a")), S.money(F.col("b")), S.metres_label(F.col("b"))).first()
    assert tuple(got) == ("45.7 msr", "0.05 ac", "$1,235", "1235 m")


def test_slope_matches_numpy(spark):
    z = np.random.default_rng(0).normal(size=(7, 9))
    g = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(7) for j in range(9)], "row int, col int, z double")
    dy, dx = np.gradient(z, 10.0)
    got = grid.slope(g).collect()
    assert all(abs(r.slope - np.hypot(dx, dy)[r.row, r.col] * 100) < 1e-9 for r in got)


def test_projections(spark):
    x, y = geo.utm(F.lit(-79.3), F.lit(39.5), 17)
    lon, lat = geo.utm_inverse(*geo.utm(F.lit(-79.3), F.lit(39.5), 17), 17)
    mx, my = geo.mercator(F.lit(-79.3), F.lit(39.5))
    blon, blat = geo.mercator_inverse(mx, my)
    r = spark.range(1).select(x, y, lon, lat, blon, blat).first()
    assert abs(r[0] - 646_155) < 100 and abs(r[1] - 4_373_600) < 1500
    assert all(abs(a - b) < 1e-8 for a, b in zip(r[2:], (-79.3, 39.5, -79.3, 39.5)))


def test_shapes(spark):
    line = spark.createDataFrame([(1, i, float(i), 0.0 if i != 5 else 3.0) for i in range(11)], "id int, pos int, x double, y double")
    assert [r.pos for r in vector.simplify(line, "id", 0.5).orderBy("pos").collect()] == [0, 4, 5, 6, 10]
    box = lambda p, x, y, w, h: [(p, x, y, x + w, y), (p, x + w, y, x + w, y + h), (p, x + w, y + h, x, y + h), (p, x, y + h, x, y)]
    rows = [*box(1, 0.0, 0.0, 40.0, 40.0), *box(1, 10.0, 10.0, 20.0, 20.0), *box(2, 35.0, 35.0, 20.0, 30.0), *box(3, 65.0, 5.0, 10.0, 10.0)]
    e = spark.createDataFrame(rows, "poly int, x1 double, y1 double, x2 double, y2 double")
    p = vector.representative_point(e).withColumnRenamed("poly", "id")
    inside = {(r.id, r.poly) for r in vector.contains(p, e).collect()}
    assert {(i, i) for i in (1, 2, 3)} <= inside
    d = {(r.a, r.b): r.distance for r in vector.polygon_distance(e, e, 25.0).collect()}
    assert d[1, 1] == d[1, 2] == 0 and d[2, 3] == d[3, 2] == 5 ** 0.5 * 10 and d[1, 3] == 25


def test_sight_and_sweep_over_flat_ground(spark):
    z = np.zeros((30, 40))
    g = spark.createDataFrame([(i, j, 0.0) for i in range(30) for j in range(40)], "row int, col int, z double")
    pairs = spark.createDataFrame([(15, 20, r, c) for r in (0, 29) for c in (0, 39)], "orow int, ocol int, trow int, tcol int")
    assert all(r.visible for r in visibility.sight(pairs, ["trow", "tcol"], g, 30, 40, F.lit(2.0), F.lit(0.1)).collect())
    assert (visibility.sweep(z, 15, 20, 0.1, 10.0) < 0.01).all()
    z[15, 22] = 50.0
    assert visibility.sweep(z, 15, 20, 0.1, 10.0)[15, 30] > 100
    req = visibility.required_heights(spark.createDataFrame([(0, 15, 20)], "pt_id long, row int, col int"), spark.createDataFrame([(i, j, float(z[i, j])) for i in range(30) for j in range(40)], g.schema), 0.0, reach=100.0)
    assert req.where("required < 0").count() > 0 and req.count() == 1200


def test_shortest_paths_match_heap_search(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60), float(r.randrange(1, 50))) for _ in range(150)]
    got = {(x.dest, x.node): x.seconds for x in routing.shortest(spark.createDataFrame(edges, "src long, dst long, travel_s double"), spark.createDataFrame([("a", 3), ("a", 9), ("b", 50)], "dest string, node long")).collect()}
    back = {}
    for s, d, w in edges:
        back.setdefault(d, []).append((s, w))
    for dest, starts in (("a", (3, 9)), ("b", (50,))):
        best, heap = {}, [(0.0, s) for s in starts]
        while heap:
            t, n = heapq.heappop(heap)
            if n not in best:
                best[n] = t
                for m, w in back.get(n, ()):
                    heapq.heappush(heap, (t + w, m))
        assert {n: s for (d, n), s in got.items() if d == dest} == best


def test_packing_round_trip(spark):
    g = spark.createDataFrame([(0, j, 700 + j / 10) for j in range(300)], "row int, col int, z double")
    assert {(r.col, round(r.z, 1)) for r in render.unpack_rows(render.pack_rows(g)).collect()} == {(j, round(700 + j / 10, 1)) for j in range(300)}
    assert spark.range(1).select(render.assign("X", F.lit("[1]")), render.stop_index(F.lit(1.0))).first()[:] == ("var X = [1];", 23)


def test_numbering(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(100)], "k int")
    assert sorted((r.k, r.idx) for r in sampling.numbered(df, "k").collect()) == [(i * 3, i) for i in range(100)]


def test_geojson_and_config(spark, tmp_path):
    ring = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 0.0]]
    made = {"features": [{"properties": {"n": "a"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"n": "b"}, "geometry": None}, {"properties": {"n": "c"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}
    (tmp_path / "a.json").write_text(json.dumps(made))
    df = geojson.read_features(spark, f"file://{tmp_path}/a.json", T.StructType([T.StructField("n", T.StringType())]))
    assert [(r.idx, r.n, len(r.rings[0])) for r in df.collect()] == [(0, "a", 4), (1, "c", 4)]
    geojson.write_features(df, f"file://{tmp_path}/out", ["n"])
    assert json.loads(spark.read.text(f"file://{tmp_path}/out").first()[0])["geometry"]["coordinates"][0] == ring
    (tmp_path / "d.json").write_text(json.dumps({"groups": []}))
    with pytest.raises(Exception, match="no destination groups"):
        geojson.read_destinations(spark, f"file://{tmp_path}/d.json").collect()
    doc = spark.createDataFrame([{"elements": [{"type": "node", "members": []}, {"type": "relation", "members": [{"type": "way", "role": None, "geometry": [{"lon": 1.0, "lat": 2.0}, {"lon": 2.0, "lat": 2.0}]}, {"type": "way", "role": "inner", "geometry": [{"lon": 1.0, "lat": 2.0}]}]}]}], "elements array<struct<type:string,members:array<struct<type:string,role:string,geometry:array<struct<lon:double,lat:double>>>>>>")
    assert [(r.outer, len(r.way)) for r in geojson.relation_ways(doc).collect()] == [(True, 2)]


def test_collections_are_read_in_splits(spark, tmp_path):
    """Many tasks, file order, texts that hold a feature's beginning, nulls."""
    ring = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 0.0]]
    made = [{"type": "Feature", "properties": {"n": f'{i} {{"type": "Feature" é' * (1 + i % 3)}, "geometry": {"type": "Polygon", "coordinates": [ring]} if i % 5 else None} for i in range(3000)]
    for k, indent in enumerate((None, 1)):
        (tmp_path / f"{k}.json").write_text(json.dumps({"type": "FeatureCollection", "features": made}, indent=indent, ensure_ascii=False))
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        try:
            df = geojson.read_features(spark, f"file://{tmp_path}/{k}.json", T.StructType([T.StructField("n", T.StringType())]))
            got = df.orderBy("idx").collect()
            text = spark.read.option("lineSep", geojson._opening(spark, f"file://{tmp_path}/{k}.json")).text(f"file://{tmp_path}/{k}.json")
            assert text.rdd.getNumPartitions() > 5
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        kept = [f for f in made if f["geometry"]]
        assert [(r.idx, r.n, len(r.rings[0])) for r in got] == [(i, f["properties"]["n"], 4) for i, f in enumerate(kept)]


def test_paged_source(spark, tmp_path):
    rows = [{"properties": {"OBJECTID": i, "name": f"p{i}"}} for i in range(25)]
    (tmp_path / "count.json").write_text(json.dumps({"count": 25}))
    for at in range(0, 25, 10):
        (tmp_path / f"{at}.json").write_text(json.dumps({"features": rows[at : at + 10]}))
    paged.register(spark)
    df = spark.read.format("ridgeline_pages").schema("OBJECTID long, name string").option("url", f"file://{tmp_path}").option("page", 10).option("wait", 0).load()
    assert sorted((r.OBJECTID, r.name) for r in df.collect()) == [(i, f"p{i}") for i in range(25)]


def test_tables_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/l.csv").write_text("address,price,url\n1 Main St.,\"$599,000\",u1\n9 Elm,,u2\n")
    parcels = spark.createDataFrame([(7, "1 MAIN ST")], "id int, address string")
    q = match_listings(stream_listings(spark, f"file://{tmp_path}/in"), parcels, "address", "id").writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.sql("SELECT * FROM found").collect()] == [(7, 599000.0, "u1")]
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert tables.cached(spark, f"file://{tmp_path}/t", make).count() == tables.cached(spark, f"file://{tmp_path}/t", make).count() == 3 and made == [1]
    g = spark.createDataFrame([(0, 0, 1.0), (0, 1, -9999.0)], "row int, col int, z double")
    tables.write_raster(g, f"file://{tmp_path}/r")
    assert [r.z for r in tables.read_raster(spark, f"file://{tmp_path}/r").orderBy("col").collect()] == [1.0, None]
    assert math.isclose(tables.read_listings(spark, f"file://{tmp_path}/in/l.csv").count(), 2)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def raster(spark, folder, spread):
    """Heights in metres of 700 rows of 64 columns, written to ``folder``."""
    z = np.random.default_rng(7).normal(0, spread, (700, 64)).round(3)
    rows = [(i, [float(v) for v in line]) for i, line in enumerate(z)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    return z * 100


def ball(cells, steps, shape):
    out = set()
    for r, c in cells:
        for i in range(-steps, steps + 1):
            for j in range(abs(i) - steps, steps - abs(i) + 1):
                if 0 <= r + i < shape[0] and 0 <= c + j < shape[1]:
                    out.add((r + i, c + j))
    return out


def test_masks_reach_the_last_row_of_the_raster(spark, tmp_path):
    folder = str(tmp_path)
    z = raster(spark, folder, 0.2)
    assert {(x.row, x.col) for x in terrain.grid_dilate(spark, folder).collect()} == ball(np.argwhere(z > 25).tolist(), 2, z.shape)
    near = [(r, c) for r, c in ball(np.argwhere(z < -20).tolist(), 1, z.shape) if not z[r, c] < -20]
    want = {r: sum(1 for a, _ in near if a == r) for r, _ in near}
    assert {x.row: x.cells for x in terrain.grid_masks(spark, folder).collect()} == want


def test_sweep_takes_the_whole_raster(spark, tmp_path):
    """All low cells on the lattice count, and land near any low cell."""
    folder = str(tmp_path)
    z = raster(spark, folder, 0.15)
    pts = [(r, c) for r, c in np.argwhere(z < -20).tolist() if r % 5 == c % 5 == 0]
    want = np.zeros(z.shape)
    for r, c in pts:
        want += np.where(visibility.sweep(z, r, c, -20.0 + visibility.TARGET_HEIGHT, 10.0) <= 8.0, visibility.SAMPLE_AREA, 0.0)
    lake = {(r, c) for r, c in np.argwhere(z < -20).tolist()}
    got = {(x.row, x.col): x.area_8m for x in terrain.viewshed_sweep(spark, folder).collect()}
    assert max(r for r, _ in got) > 500 and len(pts) > 50
    assert got == {k: float(want[k]) for k in ball(lake, 2, z.shape) - lake}


def test_boundary_distance_reaches_far_points(spark):
    r = random.Random(8)
    pts = [(i, r.uniform(-1, 1) * 10 ** r.randrange(2, 6), r.uniform(-1, 1) * 10 ** r.randrange(2, 6)) for i in range(60)]
    lines = [(1, 0.0, 0.0, 900.0, 100.0), (1, 900.0, 100.0, 300.0, 2500.0), (1, 300.0, 2500.0, 0.0, 0.0), (2, -4000.0, 10.0, -4000.0, 70.0)]

    def plain(x, y):
        out = []
        for _, x1, y1, x2, y2 in lines:
            dx, dy = x2 - x1, y2 - y1
            t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
            out.append(math.hypot(x - x1 - t * dx, y - y1 - t * dy))
        return min(out)

    edge = spark.createDataFrame(lines, "poly int, x1 double, y1 double, x2 double, y2 double")
    got = {x.id: x.distance for x in vector.boundary_distance(spark.createDataFrame(pts, "id long, x double, y double"), edge).collect()}
    assert got == pytest.approx({i: plain(x, y) for i, x, y in pts})
