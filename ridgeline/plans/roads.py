"""Queries over road networks of many short pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import scalar as S
from ridgeline.operators import routing
from ridgeline.plans.standins import GRID_SQL, LANES_SQL, fill, grid, lanes, view


def simplified_roads(spark: SparkSession, folder: str) -> DataFrame:
    """Streets with every chain of passed nodes as one edge."""
    out = routing.simplify(lanes(spark, folder), ["length_m"], ["highway"])
    return out.select("src", "dst", S.round_even(F.col("length_m"), 3).alias("length_m"), F.array_join("highway", "+").alias("highway"), "parts")


#: Chains walked edge by edge from their ends, then rings from their smallest node.
_CHAINS_SQL = f"""
e AS ({LANES_SQL}), ends AS (SELECT src AS node, dst AS other, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, src, 0, 1 FROM e),
pair AS (SELECT node, other, sum(o) AS o, sum(i) AS i FROM ends GROUP BY ALL),
mid AS MATERIALIZED (SELECT node, min(other) AS low, max(other) AS high FROM pair GROUP BY node HAVING count(*) = 2 AND bool_and(node <> other) AND max(greatest(o, i)) = 1 AND sum(o) = sum(i)),
c AS MATERIALIZED (SELECT e.*, a.low, a.high, b.node IS NOT NULL AS goes FROM e LEFT JOIN mid a ON a.node = src LEFT JOIN mid b ON b.node = dst),
walk(fs, fd, s, d, n, len, hw, goes) AS (SELECT src, dst, src, dst, 1, length_m, [highway], goes FROM c WHERE low IS NULL
  UNION ALL SELECT fs, fd, c.src, c.dst, n + 1, len + length_m, list_append(hw, highway), c.goes FROM walk w JOIN c ON w.goes AND c.src = w.d AND c.dst = CASE WHEN c.low = w.s THEN c.high ELSE c.low END),
loose AS MATERIALIZED (SELECT * FROM c ANTI JOIN (SELECT s AS src, d AS dst FROM walk) w USING (src, dst)),
turn(fs, fd, s, d, n, len, hw) AS (SELECT src, dst, src, dst, 1, length_m, [highway] FROM loose
  UNION ALL SELECT fs, fd, c.src, c.dst, n + 1, len + length_m, list_append(hw, highway) FROM turn w JOIN loose c ON c.src = w.d AND c.dst = CASE WHEN c.low = w.s THEN c.high ELSE c.low END AND w.d > w.fs),
chains AS (SELECT fs AS src, d AS dst, len, hw, n FROM walk WHERE NOT goes UNION ALL SELECT fs, d, len, hw, n FROM turn WHERE fs = d)"""


def _lane_times(spark: SparkSession, folder: str) -> DataFrame:
    return lanes(spark, folder).withColumn("maxspeed_kph", F.lit(None).cast("double")).transform(routing.travel_times)


_FROM = [("grocery", 3), ("grocery", 50), ("hospital", 77)]


def simplified_drive_times(spark: SparkSession, folder: str) -> DataFrame:
    """Times to the crossings that stay, over the simplified streets."""
    roads = routing.simplify(_lane_times(spark, folder), ["travel_s"])
    out = routing.shortest(roads, spark.createDataFrame(_FROM, "dest string, node long"))
    return out.where("node < 1000").select("dest", "node", S.round_even(F.col("seconds"), 4).alias("seconds"))


def _times_sql(edges: str, starts: list[tuple[str, int]]) -> str:
    """``times`` by relaxation over ``edges`` (src, dst, travel_s)."""
    rows = ", ".join(f"('{d}', {n}::BIGINT, 0::DOUBLE)" for d, n in starts)
    return f"""
b AS MATERIALIZED (SELECT dst AS node, src AS next, min(travel_s) AS w FROM ({edges}) WHERE src <> dst GROUP BY ALL),
times(dest, node, seconds) USING KEY (dest, node) AS (SELECT * FROM (VALUES {rows}) AS v(dest, node, seconds)
  UNION SELECT k.dest, b.next AS node, min(k.seconds + b.w) AS seconds FROM times k JOIN b ON b.node = k.node LEFT JOIN recurring.times r ON r.dest = k.dest AND r.node = b.next
    WHERE r.seconds IS NULL OR k.seconds + b.w < r.seconds GROUP BY k.dest, b.next)"""


_LANE_TIMES_SQL = f"SELECT src, dst, length_m / (CASE highway WHEN 'tertiary' THEN 55 ELSE 35 END / 3.6::DOUBLE) AS travel_s FROM ({LANES_SQL})"
_q = lambda x, d: f"(round_even(({x}) * 1e{d}::DOUBLE, 0) / 1e{d}::DOUBLE)"

#: Paths over the raster from cell to cell, slower up and down.
TRACKS = """
SELECT a.id AS src, b.id AS dst, CAST(10 AS DOUBLE) + abs(a.z - b.z) + CASE WHEN b.z > a.z THEN b.z - a.z ELSE 0 END AS travel_s
FROM (SELECT CAST(row AS BIGINT) * 4096 + col AS id, row, col, z FROM {cells} c) a
JOIN (SELECT CAST(row AS BIGINT) * 4096 + col AS id, row + dr AS r, col + dc AS c, z FROM {cells} d, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS v(dr, dc)) b ON a.row = b.r AND a.col = b.c
"""
_CAMPS = [("camp", 0), ("camp", 120 * 4096 + 40), ("summit", 77 * 4096 + 13)]


def walking_times(spark: SparkSession, folder: str) -> DataFrame:
    """Times over tracks to two destinations, the raster cut into regions."""
    g = grid(spark, folder)
    at = g.select((F.col("row").cast("long") * 4096 + F.col("col")).alias("id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    out = routing.shortest(view(spark, folder, TRACKS, cells=g), spark.createDataFrame(_CAMPS, "dest string, node long"), at, 3000)
    return out.select("dest", "node", S.round_even(F.col("seconds"), 4).alias("seconds"))


SQL: dict[str, str] = {
    "simplified_roads": f"WITH RECURSIVE {_CHAINS_SQL} SELECT src, dst, {_q('len', 3)} AS length_m, array_to_string(list_sort(list_distinct(list_filter(hw, lambda x: x IS NOT NULL))), '+') AS highway, CAST(n AS BIGINT) AS parts FROM chains",
    "simplified_drive_times": f"WITH RECURSIVE {_times_sql(_LANE_TIMES_SQL, _FROM)} SELECT dest, node, {_q('seconds', 4)} AS seconds FROM times WHERE node < 1000",
    "walking_times": f"WITH RECURSIVE {_times_sql(fill(TRACKS, cells=f'({GRID_SQL})'), _CAMPS)} SELECT dest, node, {_q('seconds', 4)} AS seconds FROM times",
}
QUERIES = {f.__name__: f for f in (simplified_roads, simplified_drive_times, walking_times)}
