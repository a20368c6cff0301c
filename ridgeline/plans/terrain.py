"""Queries over rasters, polygons, lines of sight, roads and map output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.functions import scalar as S
from ridgeline.operators import grid as G
from ridgeline.operators import render, routing, sampling, vector, visibility
from ridgeline.plans.standins import EDGES, GRID_SQL, NODES, POINTS, SHAPES, SHAPES_SQL, fill, grid, view
from ridgeline.session import cut, table
from ridgeline.sources import geojson


def _q(x: str, digits: int) -> str:
    return f"(round_even(({x}) * 1e{digits}::DOUBLE, 0) / 1e{digits}::DOUBLE)"


# --- rasters -----------------------------------------------------------------


def grid_slope(spark: SparkSession, folder: str) -> DataFrame:
    out = G.slope(grid(spark, folder))
    return out.select("row", "col", S.round_even(F.col("slope"), 4).alias("slope"))


def grid_bilinear(spark: SparkSession, folder: str) -> DataFrame:
    g = grid(spark, folder)
    height, width = _shape(g)
    p = view(spark, folder, POINTS).select("id", (F.col("y") / 20).alias("r"), (F.col("x") / 160).alias("c"))
    at = G.corners(p.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1)), F.col("r"), F.col("c"), height, width)
    return G.bilinear(at, ["id"], g).select("id", S.round_even(F.col("z"), 6).alias("z"))


def grid_warp(spark: SparkSession, folder: str) -> DataFrame:
    """The raster at cells of a finer one, turned a little and partly outside."""
    g = grid(spark, folder)
    height, width = _shape(g)
    t = g.select("row", "col")
    return G.warp(t, ["row", "col"], F.col("row") * 0.75 + F.col("col") * 0.25, F.col("col") * 0.75 - 3.5, g, height, width).select("row", "col", S.round_even(F.col("z"), 6).alias("z"))


#: Two tiles of heights by degrees that overlap; the first has gaps.
TILES = """
SELECT 0 AS place, row, col, CASE WHEN (row * 7 + col) % 17 = 0 THEN NULL ELSE z END AS z FROM {g} a WHERE col < 40
UNION ALL SELECT 1 AS place, row, col, z + CAST(1000 AS DOUBLE) AS z FROM {g} b WHERE col >= 30 AND (row + col) % 11 > 0
"""


def grid_reproject(spark: SparkSession, folder: str) -> DataFrame:
    """Two tiles by degrees, the second over the first, at the cells of a raster
    in web Mercator of 150 m that reaches beyond them."""
    g = grid(spark, folder)
    height, width = _shape(g)
    source = view(spark, folder, TILES, g=g)
    t = g.where("row < 90").select("row", "col", (F.col("col") * 150.0 - 9017100).alias("x"), (4789000 - F.col("row") * 150.0).alias("y"))
    lon, lat = geo.mercator_inverse(F.col("x"), F.col("y"))
    out = G.reproject(t, ["row", "col"], lon, lat, source, -81.0, 39.5, 0.001, -0.001, height, width)
    return out.select("row", "col", S.round_even(F.col("z"), 4).alias("z"))


def _shape(g: DataFrame) -> tuple[int, int]:
    """Height and width of a raster; 0 and 0 if it is empty."""
    row, col = g.agg(F.max("row"), F.max("col")).first()
    return (0, 0) if row is None else (row + 1, col + 1)


def grid_dilate(spark: SparkSession, folder: str) -> DataFrame:
    g = grid(spark, folder)
    return G.dilate(g.where("z > 25").select("row", "col"), 2, *_shape(g))


def grid_dilate_far(spark: SparkSession, folder: str) -> DataFrame:
    """Cells within 100 moves of the highest ones, and whether they lie within
    60 cells as the crow flies."""
    g = grid(spark, folder)
    top = g.where("z > 43").select("row", "col")
    near = G.dilate(top, 60, *_shape(g), round=True).withColumn("near", F.lit(True))
    return G.dilate(top, 100, *_shape(g)).join(near, ["row", "col"], "left").select("row", "col", F.coalesce("near", F.lit(False)).alias("near"))


def grid_distance(spark: SparkSession, folder: str) -> DataFrame:
    """How far every cell is from the lowest ones, in metres."""
    g = grid(spark, folder)
    d = G.distances(g.where("z < -33").select("row", "col"), *_shape(g))
    return d.select("row", "col", S.round_even(F.col("distance") * 10, 6).alias("distance"))


def grid_flatten(spark: SparkSession, folder: str) -> DataFrame:
    g = grid(spark, folder).withColumn("lake", F.col("z") < -10)
    return G.flatten(g, "lake").select("row", "col", S.round_even(F.col("z"), 6).alias("z"), "lake")


def grid_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Analysis mask: near the lake, but not of it; and its size."""
    g = grid(spark, folder).withColumn("lake", F.col("z") < -20)
    near = G.dilate(g.where("lake").select("row", "col"), 1, *_shape(g)).withColumn("near", F.lit(True))
    both = g.join(near, ["row", "col"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    return both.where("near AND NOT lake").groupBy("row").agg(F.count("*").alias("cells"))


_NEIGHBOURS = """
g AS ({g}), n AS (SELECT row, col, z, lag(z) OVER (PARTITION BY row ORDER BY col) AS w, lead(z) OVER (PARTITION BY row ORDER BY col) AS e,
  lag(z) OVER (PARTITION BY col ORDER BY row) AS s, lead(z) OVER (PARTITION BY col ORDER BY row) AS t FROM g),
d AS (SELECT row, col, (CASE WHEN w IS NULL THEN e - z WHEN e IS NULL THEN z - w ELSE (e - w) / 2 END) / 10 AS dx,
  (CASE WHEN s IS NULL THEN t - z WHEN t IS NULL THEN z - s ELSE (t - s) / 2 END) / 10 AS dy FROM n)""".replace("{g}", GRID_SQL)


#: The raster as one list, with its height and width.
_DIM = "dim AS MATERIALIZED (SELECT CAST(max(row) + 1 AS INT) AS hh, CAST(max(col) + 1 AS INT) AS ww, list(z ORDER BY row, col) AS zs FROM g)"


def bilinear_sql(points: str, keys: str, out: str = "z") -> str:
    """``points`` has keys, r and c; ``dim`` is the grid as above."""
    return f"""
(SELECT {keys}, (zs[i0] * (1 - fc) + zs[i0 + 1] * fc) * (1 - fr) + (zs[i0 + ww] * (1 - fc) + zs[i0 + ww + 1] * fc) * fr AS {out} FROM
  (SELECT *, r - r0 AS fr, c - c0 AS fc, r0 * ww + c0 + 1 AS i0 FROM
    (SELECT *, CAST(greatest(0, least(hh - 2, floor(r))) AS INT) AS r0, CAST(greatest(0, least(ww - 2, floor(c))) AS INT) AS c0 FROM {points}, dim)))"""


# --- polygons ----------------------------------------------------------------

_CROSS = "(y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1"
EDGE_SQL = f"(SELECT poly, x1, y1, x2, y2 FROM ({SHAPES_SQL}))"
#: Cells of 250 m over all polygons.
_CELLS_SQL = f"""(SELECT r AS row, c AS col, c * 250.0::DOUBLE + 125 AS x, r * 250.0::DOUBLE + 125 AS y
  FROM (SELECT CAST(unnest(range(CAST(floor(max(greatest(y1, y2)) / 250) + 1 AS BIGINT))) AS INT) AS r FROM {EDGE_SQL}), (SELECT CAST(unnest(range(CAST(floor(max(greatest(x1, x2)) / 250) + 1 AS BIGINT))) AS INT) AS c FROM {EDGE_SQL}))"""


def polygons(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the polygons around suppliers, by way of their rings."""
    rows = view(spark, folder, SHAPES)
    rings = rows.groupBy("poly", "ring").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("v"))
    ring = F.transform(F.concat("v", F.slice("v", 1, 1)), lambda p: F.struct(p["x"], p["y"]))
    return vector.edges(rings.select("poly", ring.alias("way")), "poly", "way")


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    far = polygons(spark, folder).agg(F.floor(F.max(F.greatest("x1", "x2")) / 250).alias("c"), F.floor(F.max(F.greatest("y1", "y2")) / 250).alias("r"))
    ids = far.select(F.explode(F.sequence(F.lit(0), F.col("r").cast("int"))).alias("row"), F.sequence(F.lit(0), F.col("c").cast("int")).alias("cols")).select("row", F.explode("cols").alias("col"))
    return ids.withColumn("x", F.col("col") * 250.0 + 125).withColumn("y", F.col("row") * 250.0 + 125)


def pip_points(spark: SparkSession, folder: str) -> DataFrame:
    return vector.contains(view(spark, folder, POINTS), polygons(spark, folder))


def rasterize_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    return vector.rasterise(_cells(spark, folder), polygons(spark, folder))


def rasterize_fill(spark: SparkSession, folder: str) -> DataFrame:
    zones = vector.rasterise(_cells(spark, folder), polygons(spark, folder))
    return vector.fill_missing(zones, polygons(spark, folder), 250.0).groupBy("zone").agg(F.count("*").alias("cells"))


def buffered_points(spark: SparkSession, folder: str) -> DataFrame:
    """Points in the polygons widened by 300 m, and whether drawn in by 150 m
    they still hold them."""
    p, e = view(spark, folder, POINTS), polygons(spark, folder)
    inner = vector.within(p, e, -150.0).withColumn("deep", F.lit(True))
    return vector.within(p, e, 300.0).join(inner, "id", "left").select("id", F.coalesce("deep", F.lit(False)).alias("deep"))


def lake_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Sample points on a lattice over polygon 4, drawn in, on its cells."""
    e = polygons(spark, folder).where("poly = 4")
    return vector.sample_points(e, vector.rasterise(_cells(spark, folder), e), 100.0, 250.0, 40.0)


def union_points(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each point lies in the union of all polygons."""
    return vector.inside_any(view(spark, folder, POINTS), polygons(spark, folder)).select("id", "inside")


def extent_points(spark: SparkSession, folder: str) -> DataFrame:
    """Points in a raster's extent of 300 x 200 cells from (1000, 9000)."""
    lit = lambda v: F.lit(float(v))
    return render.inside(view(spark, folder, POINTS), lit(1000), lit(9000), lit(300), lit(200), lit(10)).select("id")


def config_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """The box of parcels and destination points together, with a margin."""
    more = table(spark, folder, "nation").select((F.col("n_nationkey") * 700.0 - 900).alias("x"), (F.col("n_nationkey") * 90.0 - 400).alias("y"))
    return vector.bounds(view(spark, folder, POINTS), 35.0, 1.0, more)


def simplified_line(spark: SparkSession, folder: str) -> DataFrame:
    """Per segment of customers, the line through their balances, thinned."""
    c = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("id"), F.col("c_custkey").alias("pos"), F.col("c_custkey").cast("double").alias("x"), F.col("c_acctbal").alias("y"))
    return vector.simplify(c, "id", 50.0)


def representative_points(spark: SparkSession, folder: str) -> DataFrame:
    """Of every polygon, whether its point lies inside, and not in its hole."""
    p = vector.representative_point(polygons(spark, folder)).withColumnRenamed("poly", "id")
    own = vector.contains(p, polygons(spark, folder)).where("id = poly").select("id", F.lit(True).alias("inside"))
    return p.select("id").join(own, "id", "left").select(F.col("id").alias("poly"), F.coalesce("inside", F.lit(False)).alias("inside"))


def lattice_points(spark: SparkSession, folder: str) -> DataFrame:
    box = vector.bounds(view(spark, folder, POINTS), 130.0, 10.0)
    pts = vector.lattice(box, 500.0).withColumn("id", F.struct("x", "y"))
    return vector.contains(pts, polygons(spark, folder)).select("id.x", "id.y").distinct()


def data_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return vector.bounds(view(spark, folder, POINTS), 1300.0, 10.0)


def boundary_distance(spark: SparkSession, folder: str) -> DataFrame:
    d = vector.boundary_distance(view(spark, folder, POINTS), polygons(spark, folder))
    r = S.round_even(F.col("distance"), 1)
    return d.select("id", r.alias("distance"), (r <= 15).alias("waterfront"))


def polygon_distance(spark: SparkSession, folder: str) -> DataFrame:
    e = polygons(spark, folder)
    out = vector.polygon_distance(e, e, 3000.0, once=True)
    return out.select("a", "b", S.round_even(F.col("distance"), 1).alias("distance"))


def polygon_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """From every polygon to the nearest of those with a hole."""
    e = polygons(spark, folder)
    out = vector.nearest_polygon(e, e.where("poly % 5 = 0"), 400.0)
    return out.select("a", "b", S.round_even(F.col("distance"), 1).alias("distance"))


def within_distance_count(spark: SparkSession, folder: str) -> DataFrame:
    return vector.count_within(view(spark, folder, POINTS), 600.0)


def openness_argmax(spark: SparkSession, folder: str) -> DataFrame:
    n = cut(vector.count_within(view(spark, folder, POINTS), 600.0))
    q = n.agg(F.percentile("n", 0.2).alias("q"))
    near = n.join(F.broadcast(q)).agg(F.min_by("id", F.struct(F.abs(F.col("n") - F.col("q")), "id")).alias("near_p20"))  # one row
    return n.agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("most")).join(near)


def nearest_snap(spark: SparkSession, folder: str) -> DataFrame:
    return vector.nearest(view(spark, folder, POINTS), view(spark, folder, NODES))


# --- projections -------------------------------------------------------------

_LONLAT = "SELECT CAST(c_custkey AS BIGINT) AS id, CAST(-81 AS DOUBLE) + CAST(c_custkey % 500 AS DOUBLE) / CAST(250 AS DOUBLE) AS lon, CAST(39 AS DOUBLE) + CAST(c_custkey % 97 AS DOUBLE) / CAST(97 AS DOUBLE) AS lat FROM {customer}"


def utm_forward(spark: SparkSession, folder: str) -> DataFrame:
    x, y = geo.utm(F.col("lon"), F.col("lat"), 17)
    return view(spark, folder, _LONLAT).select("id", S.round_even(x, 1).alias("x"), S.round_even(y, 1).alias("y"))


def utm_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    lon, lat = geo.utm_inverse(*geo.utm(F.col("lon"), F.col("lat"), 17), 17)
    return view(spark, folder, _LONLAT).select("id", S.round_even(lon, 6).alias("lon"), S.round_even(lat, 6).alias("lat"))


def mercator_forward(spark: SparkSession, folder: str) -> DataFrame:
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    return view(spark, folder, _LONLAT).select("id", S.round_even(x, 3).alias("x"), S.round_even(y, 3).alias("y"))


def _utm_sql() -> str:
    """The projection by series in the distance from the central meridian, of
    another kind than the operator's."""
    n = "(1 / 298.257223563::DOUBLE / (2 - 1 / 298.257223563::DOUBLE))"
    m = (
        f"6378137::DOUBLE / (1 + {n}) * ((1 + {n} ** 2 / 4 + {n} ** 4 / 64) * phi - 1.5 * ({n} - {n} ** 3 / 8) * sin(2 * phi)"
        f" + 15.0::DOUBLE / 16 * ({n} ** 2 - {n} ** 4 / 4) * sin(4 * phi) - 35.0::DOUBLE / 48 * {n} ** 3 * sin(6 * phi) + 315.0::DOUBLE / 512 * {n} ** 4 * sin(8 * phi))"
    )
    x = "a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * e) * a ** 5 / 120"
    y = "a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * e) * a ** 6 / 720"
    return f"""
WITH p AS (SELECT id, radians(lat) AS phi, radians(lon + 81) AS lam, {geo.FLATTENING!r}::DOUBLE * (2 - {geo.FLATTENING!r}::DOUBLE) AS e2 FROM ({fill(_LONLAT)})),
q AS (SELECT id, phi, 6378137::DOUBLE / sqrt(1 - e2 * sin(phi) ** 2) AS nu, tan(phi) ** 2 AS t, e2 / (1 - e2) AS e, e2 / (1 - e2) * cos(phi) ** 2 AS c, lam * cos(phi) AS a, {m} AS m FROM p)
SELECT id, {_q(f"500000 + 0.9996::DOUBLE * nu * ({x})", 1)} AS x, {_q(f"0.9996::DOUBLE * (m + nu * tan(phi) * ({y}))", 1)} AS y FROM q"""


# --- visibility --------------------------------------------------------------


_OBSERVERS = [(5, 30), (100, 30), (321, 30)]


def _pairs(spark: SparkSession, g: DataFrame) -> DataFrame:
    """From a few observers to every cell of the raster."""
    obs = spark.createDataFrame(_OBSERVERS, "orow int, ocol int")
    return g.select(F.col("row").alias("trow"), F.col("col").alias("tcol"), F.col("z").alias("ground")).join(F.broadcast(obs))  # three rows


_KEYS = ["orow", "ocol", "trow", "tcol"]
_EYE, _TARGET = 45.0, 15.1


def _sight(spark: SparkSession, folder: str, step: float, up: bool) -> DataFrame:
    g = grid(spark, folder)
    return visibility.sight(_pairs(spark, g), _KEYS, g, *_shape(g), F.lit(_EYE), F.lit(_TARGET), step=step, up=up)


def los_visible(spark: SparkSession, folder: str) -> DataFrame:
    return _sight(spark, folder, 4.0, False).select(*_KEYS, "visible")


def los_browser_steps(spark: SparkSession, folder: str) -> DataFrame:
    return _sight(spark, folder, 10.0, True).select(*_KEYS, "visible")


def los_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Fine steps against coarse ones: pairs take the first result along, so
    that two results of all pairs need not be joined."""
    g = grid(spark, folder)
    ends = (g, *_shape(g), F.lit(_EYE), F.lit(_TARGET))
    fine = visibility.sight(_pairs(spark, g), _KEYS, *ends, step=4.0).withColumnRenamed("visible", "fine")
    both = visibility.sight(fine, [*_KEYS, "fine"], *ends, step=10.0, up=True)
    out = visibility.agreement(both, "fine", "visible")
    return out.select(S.round_even(F.col("percent"), 6).alias("percent"), "pairs")


def inspector_totals(spark: SparkSession, folder: str) -> DataFrame:
    out = visibility.totals(_sight(spark, folder, 10.0, True), "orow")
    return out.select("orow", "visible", S.round_even(F.col("acres"), 4).alias("acres"), S.round_even(F.col("percent"), 4).alias("percent"))


def cumulative_view(spark: SparkSession, folder: str) -> DataFrame:
    """Area and solid angle by cell from a few water points, with required
    heights along rays; per column of the raster."""
    g = grid(spark, folder)
    x = visibility.required_by_rays(_pairs(spark, g), [*_KEYS, "ground"], g, *_shape(g), F.lit(_EYE + visibility.TARGET_HEIGHT), F.col("ground"), limit=max(_EYES.values()))
    x = x.withColumn("d2", F.col("distance") * F.col("distance"))
    out = visibility.cumulative(x, ["trow", "tcol"], _EYES, F.lit(_EYE))
    return out.groupBy("tcol").agg(
        F.sum("area_2m").alias("area_2m"), F.sum("area_8m").alias("area_8m"), S.round_even(F.sum("solid_2m"), 6).alias("solid_2m"), S.round_even(F.sum("solid_8m"), 6).alias("solid_8m")
    )


_EYES = {"2m": 2.0, "8m": 8.0}
#: Water points of the sweeps: low cells on a lattice of 50 m.
_LAKE = "z < -20 AND row % 5 = 0 AND col % 5 = 0"
_WATER = -20.0


def _lake_points(g: DataFrame, width: int) -> DataFrame:
    return g.where(_LAKE).select((F.col("row").cast("long") * width + F.col("col")).alias("pt_id"), "row", "col")


def viewshed_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Cumulative layers of all lake points over the land near the lake, swept
    in tiles of 200 cells."""
    g = grid(spark, folder)
    height, width = _shape(g)
    water = g.where("z < -20")
    land = G.dilate(water.select("row", "col"), 2, height, width).join(water, ["row", "col"], "left_anti")
    pts = _lake_points(g, width)
    out = visibility.summed_views(pts, g, _WATER, _EYES, mask=land, tile=200)
    return out.select("row", "col", "area_2m", "area_8m", S.round_even(F.col("solid_2m"), 6).alias("solid_2m"), S.round_even(F.col("solid_8m"), 6).alias("solid_8m"))


def forward_view(spark: SparkSession, folder: str) -> DataFrame:
    """How many lake points are seen from a few cells, by a sweep from these."""
    g = grid(spark, folder)
    height, width = _shape(g)
    obs = spark.createDataFrame([(i, r, c, 2.0) for i, (r, c) in enumerate(_OBSERVERS)], "obs_id long, row int, col int, eye double")
    out = visibility.forward_views(obs, _lake_points(g, width), g, tile=150)
    return out.groupBy("obs_id").agg(F.count_if("visible").alias("visible"), F.count("*").alias("points"))


def _rays_sql(step: float, up: bool, eye: float) -> str:
    """Samples of all rays: keys, distance, t, the height of the terrain less
    its fall, of the target's fall, and of the ground at the target."""
    n = f"CAST(greatest(2, {'ceil' if up else 'floor'}(distance / {step}::DOUBLE)) AS INT)"
    c, r = visibility.CURVATURE, visibility.RADIUS
    obs = ", ".join(f"({a}, {b})" for a, b in _OBSERVERS)
    return f"""
g AS ({GRID_SQL}), {_DIM}, pairs AS (SELECT orow, ocol, row AS trow, col AS tcol, z AS here, sqrt((row - orow) * (row - orow) + (col - ocol) * (col - ocol)) * 10 AS distance FROM (VALUES {obs}) AS o(orow, ocol), g),
rays AS (SELECT *, {c}::DOUBLE * distance * distance / (2 * {r}::DOUBLE) AS fall, {eye!r}::DOUBLE AS eye, {n} AS n FROM pairs WHERE distance > 0),
march AS (SELECT *, k / n::DOUBLE AS t FROM (SELECT *, unnest(range(1, n)) AS k FROM rays)),
pt AS (SELECT *, orow + (trow - orow) * t AS r, ocol + (tcol - ocol) * t AS c FROM march),
samples AS (SELECT *, ground - {c}::DOUBLE * (t * distance) * (t * distance) / (2 * {r}::DOUBLE) AS level FROM {bilinear_sql("pt", "orow, ocol, trow, tcol, here, distance, fall, eye, t", "ground")})"""


def _sight_sql(step: float, up: bool) -> str:
    return f"""{_rays_sql(step, up, _EYE)}, seen AS (SELECT orow, ocol, trow, tcol, distance,
  bool_and(eye + t * ({_TARGET}::DOUBLE - fall - eye) >= level - 1e-6::DOUBLE) AS visible FROM samples GROUP BY ALL)"""


def _sweep_sql(points: str, start: str) -> str:
    """``need`` (pt, row, col, z, dist, need): the sweep, ring by ring.  A cell
    of ring k looks at the two cells of ring k - 1 beside its ray.

    ``points`` has (pt, prow, pcol); ``start`` is the height of a point's eye.
    """
    c, r = visibility.CURVATURE, visibility.RADIUS
    return f"""
pts AS ({points}),
cells AS (SELECT pt, row, col, z, row - prow AS dr, col - pcol AS dc, greatest(abs(row - prow), abs(col - pcol)) AS k,
  sqrt((row - prow) * (row - prow) + (col - pcol) * (col - pcol)) * 10 AS dist, ({start}) AS eye, prow, pcol FROM pts, g),
lines AS (SELECT *, z - {c}::DOUBLE * dist * dist / (2 * {r}::DOUBLE) - eye AS flat, CASE WHEN abs(dc) > abs(dr) THEN dr ELSE dc END AS j FROM cells WHERE k > 0),
look AS MATERIALIZED (SELECT *, flat / dist AS slope, (j * (k - 1)) // k - CASE WHEN j < 0 AND (j * (k - 1)) % k <> 0 THEN 1 ELSE 0 END AS low FROM lines),
two AS MATERIALIZED (SELECT *, (j * (k - 1) - low * k) / k::DOUBLE AS f,
  CASE WHEN abs(dc) > abs(dr) THEN prow + low ELSE prow + sign(dr) * (k - 1) END AS r0, CASE WHEN abs(dc) > abs(dr) THEN pcol + sign(dc) * (k - 1) ELSE pcol + low END AS c0,
  CASE WHEN abs(dc) > abs(dr) THEN prow + low + 1 ELSE prow + sign(dr) * (k - 1) END AS r1, CASE WHEN abs(dc) > abs(dr) THEN pcol + sign(dc) * (k - 1) ELSE pcol + low + 1 END AS c1 FROM look),
rings AS (SELECT pt, k, row, col, slope AS top, NULL::DOUBLE AS lift FROM look WHERE k = 1
  UNION ALL SELECT t.pt, t.k, t.row, t.col, greatest(t.slope, h) AS top, h * t.dist AS lift FROM (
    SELECT t.*, CASE WHEN t.f = 0 THEN a.top ELSE a.top * (1 - t.f) + b.top * t.f END AS h
    FROM two t JOIN rings a ON a.pt = t.pt AND a.k = t.k - 1 AND a.row = t.r0 AND a.col = t.c0
    LEFT JOIN rings b ON b.pt = t.pt AND b.row = t.r1 AND b.col = t.c1 AND t.f > 0) t),
need AS (SELECT l.pt, l.row, l.col, l.z, l.dist, l.eye, CASE WHEN lift IS NULL THEN 0 ELSE greatest(0, lift - flat) END AS need FROM lines l LEFT JOIN rings r USING (pt, row, col)
  UNION ALL SELECT pt, row, col, z, 0, eye, 0 FROM cells WHERE k = 0)"""


# --- roads -------------------------------------------------------------------

_SPEED_CASE = "CASE highway " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in routing.SPEEDS.items()) + " END"
EDGE_TIMES_SQL = f"""
e AS ({fill(EDGES)}), m AS (SELECT highway, avg(maxspeed_kph) AS mean FROM e GROUP BY highway),
t AS (SELECT e.*, coalesce(maxspeed_kph, {_SPEED_CASE}, mean, 35::DOUBLE) AS speed_kph FROM e JOIN m USING (highway)),
w AS (SELECT *, length_m / (speed_kph / 3.6::DOUBLE) AS travel_s FROM t)"""
_SOURCES = [("grocery", 3), ("grocery", 50), ("hospital", 77)]


def edge_speed_fill(spark: SparkSession, folder: str) -> DataFrame:
    e = routing.travel_times(view(spark, folder, EDGES))
    return e.groupBy("highway", "speed_kph").agg(F.count("*").alias("n"), S.round_even(F.sum("travel_s"), 3).alias("seconds"))


def _times(spark: SparkSession, folder: str) -> DataFrame:
    e = routing.travel_times(view(spark, folder, EDGES))
    return routing.shortest(e, spark.createDataFrame(_SOURCES, "dest string, node long"))


def drive_times(spark: SparkSession, folder: str) -> DataFrame:
    return _times(spark, folder).select("dest", "node", S.round_even(F.col("seconds"), 4).alias("seconds"))


def drive_pivot(spark: SparkSession, folder: str) -> DataFrame:
    snapped = vector.nearest(view(spark, folder, POINTS), view(spark, folder, NODES)).select("id", "node")
    return routing.minutes(snapped, _times(spark, folder), ["grocery", "hospital"])


DRIVE_SQL = f"""{EDGE_TIMES_SQL}, b AS MATERIALIZED (SELECT dst AS node, src AS next, min(travel_s) AS w FROM w WHERE src <> dst GROUP BY ALL),
walk(dest, node, seconds) USING KEY (dest, node) AS (SELECT * FROM (VALUES ('grocery', 3::BIGINT, 0::DOUBLE), ('grocery', 50, 0), ('hospital', 77, 0)) AS v(dest, node, seconds)
  UNION SELECT k.dest, b.next AS node, min(k.seconds + b.w) AS seconds FROM walk k JOIN b ON b.node = k.node LEFT JOIN recurring.walk r ON r.dest = k.dest AND r.node = b.next
    WHERE r.seconds IS NULL OR k.seconds + b.w < r.seconds GROUP BY k.dest, b.next),
times AS (SELECT dest, node, seconds FROM walk)"""
_SNAP_SQL = f"""p AS ({fill(POINTS)}), s AS ({fill(NODES)}), snap AS (
  SELECT p.id, arg_min(s.id, ((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) * 1000000 + s.id) AS node, min((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) AS d2 FROM p, s GROUP BY p.id)"""


def road_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Roads with an end in a box, and of these the largest connected part."""
    sparse = view(spark, folder, _SPARSE)
    near = routing.clip(view(spark, folder, NODES), sparse, (0.0, 0.0, 9000.0, 8000.0))
    return routing.largest_component(near)


#: Roads from node to node in many small pieces.
_SPARSE = """
SELECT CAST(s_suppkey AS BIGINT) AS src, CAST(CASE WHEN s_suppkey % 23 = 0 THEN s_suppkey ELSE s_suppkey + CASE WHEN s_suppkey % 11 < 6 THEN 1 ELSE 11 END END AS BIGINT) AS dst FROM {supplier}
"""


# --- map output and sources --------------------------------------------------


def heat_rgba(spark: SparkSession, folder: str) -> DataFrame:
    return render.heat(grid(spark, folder), "z", F.lit(20.0)).select("row", "col", "r", "g", "b", "a")


def _heat_sql() -> str:
    """The ramp from its fixed tables: the polynomial at 256 steps, moved to
    the legend's colours at its stops."""
    stops = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(render.LEGEND))
    poly = {n: " + ".join(f"{v!r}::DOUBLE * u ** {k}" for k, v in enumerate(c)) for n, c in render.TURBO.items()}
    lack = lambda n: f"({n} + 0.5::DOUBLE) / 255 - ({poly[n]}) AS l{n}"
    out = ", ".join(f"CAST(floor(greatest(0, least(1, {poly[n]} + a.l{n} + (coalesce(b.l{n}, a.l{n}) - a.l{n}) * coalesce((x.i - a.at) / (b.at - a.at)::DOUBLE, 0))) * 255) AS INT) AS {n}" for n in "rgb")
    return f"""
WITH s AS (SELECT *, {lack("r")}, {lack("g")}, {lack("b")} FROM (SELECT *, least(255, CAST(floor(sqrt(k / 23::DOUBLE) * 256) AS INT)) AS at, least(255, floor(sqrt(k / 23::DOUBLE) * 256)) / 255::DOUBLE AS u FROM (VALUES {stops}) AS v(k, r, g, b))),
x AS (SELECT i, i / 255::DOUBLE AS u FROM (SELECT unnest(range(256)) AS i)),
p AS (SELECT x.i, x.u, max(s.k) AS k FROM x JOIN s ON s.at <= x.i GROUP BY ALL),
ramp AS (SELECT x.i, {out.replace("u **", "x.u **")} FROM p x JOIN s a ON a.k = x.k LEFT JOIN s b ON b.k = x.k + 1)
SELECT row, col, r, g, b, a FROM (SELECT row, col, CAST(least(255, floor(t * 256)) AS INT) AS i, CASE WHEN z > 0 THEN CAST(greatest(90, floor(sqrt(t) * 255)) AS INT) ELSE 0 END AS a
  FROM (SELECT *, sqrt(greatest(0::DOUBLE, least(1::DOUBLE, z / 20))) AS t FROM ({GRID_SQL}))) q JOIN ramp USING (i)"""


def legend_stops(spark: SparkSession, folder: str) -> DataFrame:
    """The legend's stops with the number of parts by size that each colours."""
    part = table(spark, folder, "part").select(render.stop_index(F.col("p_size") / 50.0).alias("i"))
    return render.legend(spark).join(part.groupBy("i").agg(F.count("*").alias("parts")), "i")


def dem_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Packed rows read back: heights in decimetres over a datum."""
    g = grid(spark, folder).withColumn("z", F.col("z") + 1000)
    return render.unpack_rows(render.pack_rows(g))


def dem_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Heights of a few cells from packed rows, of which only these are read."""
    g = grid(spark, folder).withColumn("z", F.col("z") + 1000)
    asked = table(spark, folder, "nation").select((F.col("n_nationkey") * 19).alias("row"), (F.col("n_nationkey") * 2 + F.col("n_regionkey")).alias("col"))
    return render.heights_at(render.pack_rows(g), asked)


def strided_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.strided(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 120)


def chunk_sizes(spark: SparkSession, folder: str) -> DataFrame:
    out = sampling.chunked(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 56)
    return out.groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def geojson_export(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation").withColumn("x", F.col("n_nationkey") / 7.0)
    ring = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("x") * 2 + dy).alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 0))])
    f = geojson.feature(["n_nationkey", "n_name"], F.array(ring))
    return n.select(F.col("n_nationkey").alias("id"), F.get_json_object(f, "$.properties.n_name").alias("name"), F.get_json_object(f, "$.geometry.coordinates[0][1][0]").cast("double").alias("x1"), F.get_json_object(f, "$.geometry.type").alias("kind"))


def json_config(spark: SparkSession, folder: str) -> DataFrame:
    """Destination points from a configuration built of nations by region."""
    n = table(spark, folder, "nation")
    p = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("lat"), (-F.col("n_nationkey")).cast("double").alias("lon")))).alias("points"))
    g = p.agg(F.collect_list(F.struct(F.col("n_regionkey").cast("string").alias("id"), F.concat(F.lit("R"), "n_regionkey").alias("label"), "points")).alias("groups"))
    cfg = g.select(F.from_json(F.to_json(F.struct("groups")), geojson.DESTINATIONS).alias("c")).select("c.*")
    return geojson.destination_points(cfg)


_SEGMENT = "(SELECT sqrt((x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2) FROM (SELECT x2 - x1 AS dx, y2 - y1 AS dy, greatest(0::DOUBLE, least(1::DOUBLE, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t))"
#: Distances of polygons: 0 where edges cross or a vertex is inside, else the
#: least from a vertex of one to an edge of the other.
_APART = f"""
e AS {EDGE_SQL}, v AS (SELECT poly AS id, x1 AS x, y1 AS y FROM e),
ends AS (SELECT id AS a, poly AS b, min({_SEGMENT}) AS d FROM v, e GROUP BY ALL),
inside AS (SELECT id AS a, poly AS b FROM (SELECT id, x, y, poly FROM v, e WHERE {_CROSS} GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY ALL),
crossing AS (SELECT DISTINCT p.poly AS a, q.poly AS b FROM e p, e q WHERE
  sign((p.x2 - p.x1) * (q.y1 - p.y1) - (p.y2 - p.y1) * (q.x1 - p.x1)) * sign((p.x2 - p.x1) * (q.y2 - p.y1) - (p.y2 - p.y1) * (q.x2 - p.x1)) < 0 AND
  sign((q.x2 - q.x1) * (p.y1 - q.y1) - (q.y2 - q.y1) * (p.x1 - q.x1)) * sign((q.x2 - q.x1) * (p.y2 - q.y1) - (q.y2 - q.y1) * (p.x2 - q.x1)) < 0),
apart AS (SELECT a, b, min(d) AS v FROM (SELECT a, b, d FROM ends UNION ALL SELECT b, a, d FROM ends UNION ALL SELECT a, b, 0 FROM inside UNION ALL SELECT b, a, 0 FROM inside UNION ALL SELECT a, b, 0 FROM crossing) GROUP BY ALL)"""
#: Area and solid angle of rows (z, need, r2) at both eye heights.
_LAYERS_SQL = ", ".join(
    f"sum(CASE WHEN need <= {e} THEN 2500::DOUBLE ELSE 0 END) AS area_{n}, "
    + _q(f"sum(CASE WHEN need <= {e} THEN 2500 * greatest(0.5::DOUBLE, z + {e} - {{water}}) / (r2 + greatest(0.5::DOUBLE, z + {e} - {{water}}) ** 2) ** 1.5::DOUBLE ELSE 0 END)", 6) + f" AS solid_{n}"
    for n, e in (("2m", 2), ("8m", 8))
)

SQL: dict[str, str] = {
    "grid_slope": f"WITH {_NEIGHBOURS} SELECT row, col, {_q('sqrt(dx * dx + dy * dy) * 100', 4)} AS slope FROM d",
    "grid_bilinear": f"WITH g AS ({GRID_SQL}), {_DIM}, p AS (SELECT id, y / 20 AS r, x / 160 AS c FROM ({fill(POINTS)}), dim WHERE y / 20 BETWEEN 0 AND hh - 1 AND x / 160 BETWEEN 0 AND ww - 1) SELECT id, {_q('z', 6)} AS z FROM {bilinear_sql('p', 'id')}",
    "grid_warp": f"WITH g AS ({GRID_SQL}), {_DIM}, p AS (SELECT * FROM (SELECT row, col, row * 0.75::DOUBLE + col * 0.25::DOUBLE AS r, col * 0.75::DOUBLE - 3.5::DOUBLE AS c, hh - 1 AS lr, ww - 1 AS lc FROM g, dim) WHERE r BETWEEN 0 AND lr AND c BETWEEN 0 AND lc) SELECT row, col, {_q('z', 6)} AS z FROM {bilinear_sql('p', 'row, col')}",
    "grid_reproject": f"""
WITH g AS ({GRID_SQL}), dim AS (SELECT max(row) + 1 AS hh, max(col) + 1 AS ww FROM g), m AS (SELECT * FROM ({fill(TILES)}) WHERE z IS NOT NULL),
t AS (SELECT row, col, (degrees(2 * atan(exp((4789000 - row * 150.0::DOUBLE) / 6378137::DOUBLE)) - pi() / 2) - 39.5::DOUBLE) / -0.001::DOUBLE - 0.5::DOUBLE AS r, (degrees((col * 150.0::DOUBLE - 9017100) / 6378137::DOUBLE) + 81) / 0.001::DOUBLE - 0.5::DOUBLE AS c FROM g WHERE row < 90),
n AS (SELECT t.row, t.col, CAST(floor(r) AS INT) + i AS mr, CAST(floor(c) AS INT) + j AS mc, (CASE i WHEN 1 THEN r - floor(r) ELSE 1 - r + floor(r) END) * (CASE j WHEN 1 THEN c - floor(c) ELSE 1 - c + floor(c) END) AS w
  FROM t, dim, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(i, j) WHERE r BETWEEN -0.5 AND hh - 0.5 AND c BETWEEN -0.5 AND ww - 0.5)
SELECT row, col, {_q('arg_max(v, place)', 4)} AS z FROM (SELECT n.row, n.col, place, sum(w * z) / sum(w) AS v FROM n JOIN m ON m.row = mr AND m.col = mc WHERE w > 0 GROUP BY ALL) GROUP BY row, col""",
    "grid_dilate": f"WITH g AS ({GRID_SQL}), s AS (SELECT row, col FROM g WHERE z > 25) SELECT DISTINCT g.row, g.col FROM g JOIN s ON abs(g.row - s.row) + abs(g.col - s.col) <= 2",
    "grid_dilate_far": f"WITH g AS ({GRID_SQL}), s AS (SELECT row, col FROM g WHERE z > 43), d AS (SELECT g.row, g.col, min(abs(g.row - s.row) + abs(g.col - s.col)) AS a, min((g.row - s.row) ** 2 + (g.col - s.col) ** 2) AS b FROM g, s GROUP BY ALL) SELECT row, col, b <= 3600 AS near FROM d WHERE a <= 100 OR b <= 3600 AND a <= 100",
    "grid_distance": f"WITH g AS ({GRID_SQL}), s AS (SELECT row, col FROM g WHERE z < -33) SELECT g.row, g.col, {_q('sqrt(min((g.row - s.row) ** 2 + (g.col - s.col) ** 2)) * 10', 6)} AS distance FROM g, s GROUP BY ALL",
    "grid_flatten": f"WITH g AS ({GRID_SQL}) SELECT row, col, {_q('CASE WHEN z < -10 THEN (SELECT median(z) FROM g WHERE z < -10) ELSE z END', 6)} AS z, z < -10 AS lake FROM g",
    "grid_masks": f"WITH g AS ({GRID_SQL}), s AS (SELECT row, col FROM g WHERE z < -20), n AS (SELECT DISTINCT g.row, g.col FROM g JOIN s ON abs(g.row - s.row) + abs(g.col - s.col) <= 1) SELECT row, CAST(count(*) AS BIGINT) AS cells FROM n JOIN g USING (row, col) WHERE NOT z < -20 GROUP BY row",
    "pip_points": f"SELECT id, poly FROM ({fill(POINTS)}), {EDGE_SQL} WHERE {_CROSS} GROUP BY id, poly HAVING count(*) % 2 = 1",
    "rasterize_last_wins": f"SELECT row, col, max(poly) AS zone FROM (SELECT row, col, poly FROM {_CELLS_SQL}, {EDGE_SQL} WHERE {_CROSS} GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY ALL",
    "rasterize_fill": f"""
WITH z AS (SELECT row, col, max(poly) AS zone FROM (SELECT row, col, poly FROM {_CELLS_SQL}, {EDGE_SQL} WHERE {_CROSS} GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY ALL),
m AS (SELECT * FROM {EDGE_SQL} WHERE poly NOT IN (SELECT zone FROM z)),
s AS (SELECT c.row, c.col, m.poly, (x2 - x1) * (yc - y1) - (y2 - y1) * (xc - x1) AS side FROM {_CELLS_SQL} c, m, (VALUES (0, 0), (250, 0), (0, 250), (250, 250)) AS k(kx, ky), LATERAL (SELECT c.x - 125 + kx AS xc, c.y - 125 + ky AS yc)
  WHERE greatest(x1, x2) >= c.x - 125 AND least(x1, x2) <= c.x + 125 AND greatest(y1, y2) >= c.y - 125 AND least(y1, y2) <= c.y + 125),
t AS (SELECT row, col, max(poly) AS zone FROM (SELECT s.row, s.col, s.poly FROM s GROUP BY ALL HAVING min(side) <= 0 AND max(side) >= 0) GROUP BY ALL)
SELECT zone, CAST(count(*) AS BIGINT) AS cells FROM (SELECT * FROM z UNION ALL SELECT t.* FROM t ANTI JOIN z USING (row, col)) GROUP BY zone""",
    "buffered_points": f"""
WITH p AS ({fill(POINTS)}), e AS {EDGE_SQL}, i AS (SELECT DISTINCT id FROM (SELECT id, poly FROM p, e WHERE {_CROSS} GROUP BY ALL HAVING count(*) % 2 = 1)),
d AS (SELECT id, min(v) AS v FROM (SELECT id, {_SEGMENT} AS v FROM p, e) GROUP BY id)
SELECT id, i.id IS NOT NULL AND v > 150 AS deep FROM d LEFT JOIN i USING (id) WHERE i.id IS NOT NULL OR v <= 300""",
    "lake_samples": f"""
WITH e AS MATERIALIZED (SELECT * FROM {EDGE_SQL} WHERE poly = 4), o AS (SELECT floor(min(x1) + 40) AS ox, floor(min(y1) + 40) AS oy FROM e), l AS (SELECT ox + i * 100 AS x, oy + j * 100 AS y FROM o, (SELECT unnest(range(60)) AS i), (SELECT unnest(range(60)) AS j)),
i AS (SELECT x, y FROM l, e WHERE {_CROSS} GROUP BY ALL HAVING count(*) % 2 = 1), d AS (SELECT x, y FROM (SELECT x, y, {_SEGMENT} AS v FROM i, e) GROUP BY x, y HAVING min(v) > 40),
c AS (SELECT row, col FROM {_CELLS_SQL}, e WHERE {_CROSS} GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT row, col, col * 250.0::DOUBLE + 125 AS x, row * 250.0::DOUBLE + 125 AS y FROM (SELECT CAST(floor(y / 250) AS INT) AS row, CAST(floor(x / 250) AS INT) AS col FROM d) JOIN c USING (row, col)""",
    "union_points": f"WITH p AS ({fill(POINTS)}), i AS (SELECT DISTINCT id FROM (SELECT id, poly FROM p, {EDGE_SQL} WHERE {_CROSS} GROUP BY ALL HAVING count(*) % 2 = 1)) SELECT p.id, i.id IS NOT NULL AS inside FROM p LEFT JOIN i USING (id)",
    "extent_points": f"SELECT id FROM ({fill(POINTS)}) WHERE x >= 1000 AND x <= 4000 AND y <= 9000 AND y >= 7000",
    "config_bounds": f"WITH p AS (SELECT x, y FROM ({fill(POINTS)}) UNION ALL SELECT n_nationkey * 700.0::DOUBLE - 900, n_nationkey * 90.0::DOUBLE - 400 FROM nation) SELECT floor(min(x) - 35) AS x1, floor(min(y) - 35) AS y1, ceil(max(x) + 35) AS x2, ceil(max(y) + 35) AS y2 FROM p",
    "simplified_line": """
WITH RECURSIVE p AS (SELECT c_mktsegment AS id, c_custkey AS pos, c_custkey::DOUBLE AS x, c_acctbal AS y FROM customer),
parts(id, a, b) AS (SELECT id, min(pos), max(pos) FROM p GROUP BY id
  UNION ALL SELECT id, unnest([a, m]), unnest([m, b]) FROM (
    SELECT s.id, s.a, s.b, arg_max(q.pos, abs((q.x - u.x) * (v.y - u.y) - (q.y - u.y) * (v.x - u.x)) / sqrt((v.x - u.x) ** 2 + (v.y - u.y) ** 2)) AS m
    FROM parts s JOIN p q ON q.id = s.id AND q.pos > s.a AND q.pos < s.b JOIN p u ON u.id = s.id AND u.pos = s.a JOIN p v ON v.id = s.id AND v.pos = s.b GROUP BY s.id, s.a, s.b
    HAVING max(abs((q.x - u.x) * (v.y - u.y) - (q.y - u.y) * (v.x - u.x)) / sqrt((v.x - u.x) ** 2 + (v.y - u.y) ** 2)) > 50) t)
SELECT id, pos, x, y FROM p WHERE (id, pos) IN (SELECT (id, a) FROM parts UNION SELECT (id, b) FROM parts)""",
    "representative_points": f"SELECT DISTINCT poly, true AS inside FROM {EDGE_SQL}",
    "lattice_points": f"""
WITH p AS ({fill(POINTS)}), b AS (SELECT floor((min(x) - 130) / 10) * 10 AS x1, floor((min(y) - 130) / 10) * 10 AS y1, ceil((max(x) + 130) / 10) * 10 AS x2, ceil((max(y) + 130) / 10) * 10 AS y2 FROM p),
l AS (SELECT floor(x1) + i * 500 AS x, floor(y1) + j * 500 AS y FROM b, (SELECT unnest(range(60)) AS i), (SELECT unnest(range(60)) AS j) WHERE floor(x1) + i * 500 <= x2 AND floor(y1) + j * 500 <= y2)
SELECT DISTINCT x, y FROM (SELECT x, y, poly FROM l, {EDGE_SQL} WHERE {_CROSS} GROUP BY ALL HAVING count(*) % 2 = 1)""",
    "data_bounds": f"SELECT floor((min(x) - 1300) / 10) * 10 AS x1, floor((min(y) - 1300) / 10) * 10 AS y1, ceil((max(x) + 1300) / 10) * 10 AS x2, ceil((max(y) + 1300) / 10) * 10 AS y2 FROM ({fill(POINTS)})",
    "boundary_distance": f"SELECT id, {_q('v', 1)} AS distance, {_q('v', 1)} <= 15 AS waterfront FROM (SELECT id, min(v) AS v FROM (SELECT id, {_SEGMENT} AS v FROM ({fill(POINTS)}), {EDGE_SQL}) GROUP BY id)",
    "polygon_distance": f"WITH {_APART} SELECT a, b, {_q('v', 1)} AS distance FROM apart WHERE a < b AND v <= 3000",
    "polygon_nearest": f"WITH {_APART} SELECT a, arg_min(b, v * 1000 + b) AS b, {_q('min(v)', 1)} AS distance FROM apart WHERE b % 5 = 0 GROUP BY a",
    "within_distance_count": f"WITH p AS ({fill(POINTS)}) SELECT a.id, CAST(count(*) AS BIGINT) AS n FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 360000 GROUP BY a.id",
    "openness_argmax": f"""
WITH p AS ({fill(POINTS)}), n AS (SELECT a.id, count(*) AS n FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 360000 GROUP BY a.id), q AS (SELECT quantile_cont(n, 0.2) AS q FROM n)
SELECT (SELECT id FROM n ORDER BY n DESC, id LIMIT 1) AS most, (SELECT id FROM n, q ORDER BY abs(n - q), id LIMIT 1) AS near_p20""",
    "nearest_snap": f"WITH {_SNAP_SQL} SELECT id, node, d2 FROM snap",
    "utm_forward": _utm_sql(),
    "utm_round_trip": f"SELECT id, {_q('lon', 6)} AS lon, {_q('lat', 6)} AS lat FROM ({fill(_LONLAT)})",
    "mercator_forward": f"SELECT id, {_q('6378137.0::DOUBLE * radians(lon)', 3)} AS x, {_q('6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(lat) / 2))', 3)} AS y FROM ({fill(_LONLAT)})",
    "los_visible": f"WITH {_sight_sql(4.0, False)} SELECT orow, ocol, trow, tcol, visible FROM seen",
    "los_browser_steps": f"WITH {_sight_sql(10.0, True)} SELECT orow, ocol, trow, tcol, visible FROM seen",
    "los_agreement": f"WITH x AS (WITH {_sight_sql(4.0, False)} SELECT * FROM seen), y AS (WITH {_sight_sql(10.0, True)} SELECT * FROM seen) SELECT {_q('avg(CASE WHEN x.visible = y.visible THEN 1.0::DOUBLE ELSE 0 END) * 100', 6)} AS percent, CAST(count(*) AS BIGINT) AS pairs FROM x JOIN y USING (orow, ocol, trow, tcol)",
    "inspector_totals": f"WITH {_sight_sql(10.0, True)} SELECT orow, CAST(count_if(visible) AS BIGINT) AS visible, {_q('count_if(visible) * 2500.0::DOUBLE / 4046.86::DOUBLE', 4)} AS acres, {_q('avg(CASE WHEN visible THEN 1.0::DOUBLE ELSE 0 END) * 100', 4)} AS percent FROM seen GROUP BY orow",
    "cumulative_view": f"""
WITH {_rays_sql(4.0, False, _EYE + visibility.TARGET_HEIGHT)}, need AS (SELECT tcol, z, distance, greatest(0, m - z + fall) AS need FROM (SELECT orow, ocol, trow, tcol, here AS z, distance, fall, max(eye + (level - eye) / t) AS m FROM samples GROUP BY ALL)),
x AS (SELECT *, greatest(625::DOUBLE, distance * distance) AS r2 FROM need)
SELECT tcol, {_LAYERS_SQL.format(water=_EYE)} FROM x GROUP BY tcol""",
    "viewshed_sweep": f"""
WITH RECURSIVE g AS ({GRID_SQL}), lake AS (SELECT row, col FROM g WHERE z < -20), land AS (SELECT DISTINCT g.row, g.col FROM g JOIN lake l ON abs(g.row - l.row) + abs(g.col - l.col) <= 2 WHERE g.z >= -20),
{_sweep_sql(f"SELECT row * 64 + col AS pt, row AS prow, col AS pcol FROM g WHERE {_LAKE}", repr(_WATER + visibility.TARGET_HEIGHT) + "::DOUBLE")},
x AS (SELECT row, col, z, need, greatest(625::DOUBLE, dist * dist) AS r2 FROM need JOIN land USING (row, col))
SELECT row, col, {_LAYERS_SQL.format(water=f"({_WATER})")} FROM x GROUP BY row, col""",
    "forward_view": f"""
WITH RECURSIVE g AS ({GRID_SQL}), lake AS (SELECT row, col FROM g WHERE {_LAKE}),
{_sweep_sql("SELECT o.i AS pt, g.row AS prow, g.col AS pcol, g.z + 2 AS up FROM g JOIN (VALUES " + ", ".join(f"({i}, {r}, {c})" for i, (r, c) in enumerate(_OBSERVERS)) + ") AS o(i, r, c) ON g.row = o.r AND g.col = o.c", "up")}
SELECT CAST(pt AS BIGINT) AS obs_id, CAST(count_if(need <= {visibility.TARGET_HEIGHT}::DOUBLE) AS BIGINT) AS visible, CAST(count(*) AS BIGINT) AS points FROM need JOIN lake USING (row, col) GROUP BY pt""",
    "road_graph": f"""
WITH RECURSIVE n AS ({fill(NODES)}), e AS (SELECT src, dst FROM ({fill(_SPARSE)}) WHERE src IN (SELECT id FROM n WHERE x <= 9000 AND y <= 8000) OR dst IN (SELECT id FROM n WHERE x <= 9000 AND y <= 8000)),
u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), reach(node, seen) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM reach r JOIN u ON u.a = r.seen),
c AS (SELECT node, min(seen) AS label FROM reach GROUP BY node), best AS (SELECT label FROM c GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT src, dst FROM e JOIN c ON c.node = e.src WHERE label = (SELECT label FROM best)""",
    "dem_lookup": f"SELECT row, col, round_even((z + 1000) * 10, 0) / 10 AS z FROM ({GRID_SQL}) JOIN (SELECT DISTINCT n_nationkey * 19 AS row, n_nationkey * 2 + n_regionkey AS col FROM nation) USING (row, col)",
    "edge_speed_fill": f"WITH {EDGE_TIMES_SQL} SELECT highway, speed_kph, CAST(count(*) AS BIGINT) AS n, {_q('sum(travel_s)', 3)} AS seconds FROM w GROUP BY ALL",
    "drive_times": f"WITH RECURSIVE {DRIVE_SQL} SELECT dest, node, {_q('seconds', 4)} AS seconds FROM times",
    "drive_pivot": f"WITH RECURSIVE {DRIVE_SQL}, {_SNAP_SQL} SELECT id, node, "
    + ", ".join(f"(SELECT {_q('seconds / 60 * 1.4::DOUBLE', 1)} FROM times t WHERE t.node = snap.node AND dest = '{d}') AS drive_{d}_min" for d in ("grocery", "hospital"))
    + " FROM snap",
    "heat_rgba": _heat_sql(),
    "legend_stops": "SELECT t.*, n.parts FROM (SELECT CAST(floor((p_size / 50.0::DOUBLE) ** 2 * 23 + 0.5) AS INT) AS i, CAST(count(*) AS BIGINT) AS parts FROM part GROUP BY 1) n JOIN (VALUES " + ", ".join(f"({i}, {i}::DOUBLE / 23, {r}, {g}, {b})" for i, (r, g, b) in enumerate(render.LEGEND)) + ") AS t(i, frac, r, g, b) USING (i)",
    "dem_pack": f"SELECT row, col, round_even((z + 1000) * 10, 0) / 10 AS z FROM ({GRID_SQL})",
    "strided_sample": "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM o WHERE i % greatest(1, n // 120) = 0 ORDER BY i LIMIT 120",
    "chunk_sizes": "SELECT CAST(c - 1 AS INT) AS chunk, CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, ntile(56) OVER (ORDER BY o_orderkey) AS c FROM orders) GROUP BY c",
    "geojson_export": f"SELECT n_nationkey AS id, n_name AS name, {_q('n_nationkey / 7.0::DOUBLE + 1', 6)} AS x1, 'Polygon' AS kind FROM nation",
    "json_config": "SELECT CAST(n_regionkey AS VARCHAR) AS id, 'R' || n_regionkey AS label, n_name AS name, n_nationkey::DOUBLE AS lat, -n_nationkey::DOUBLE AS lon FROM nation",
}
QUERIES = {
    f.__name__: f
    for f in (
        grid_slope, grid_bilinear, grid_warp, grid_reproject, buffered_points, lake_samples, union_points, extent_points, config_bounds, simplified_line, representative_points,
        polygon_nearest, forward_view, road_graph, dem_lookup, grid_dilate, grid_dilate_far, grid_distance, grid_flatten, grid_masks, pip_points, rasterize_last_wins, rasterize_fill, lattice_points, data_bounds,
        boundary_distance, polygon_distance, within_distance_count, openness_argmax, nearest_snap, utm_forward, utm_round_trip, mercator_forward,
        los_visible, los_browser_steps, los_agreement, inspector_totals, cumulative_view, viewshed_sweep, edge_speed_fill, drive_times, drive_pivot,
        heat_rgba, legend_stops, dem_pack, strided_sample, chunk_sizes, geojson_export, json_config,
    )
}
