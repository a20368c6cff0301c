"""The engine's inputs, derived by arithmetic from the test tables.

Each text runs in Spark and in DuckDB alike; table names in braces are filled
in by ``view`` and ``plain``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ridgeline.session import table

PARCELS = """
SELECT CAST(p_partkey AS BIGINT) AS parcel_idx, p_name AS address,
  CASE WHEN p_size % 13 = 0 THEN NULL WHEN p_size % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) / CAST(4 AS DOUBLE) END AS acres,
  CASE WHEN p_partkey % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE p_retailprice * CAST(100 AS DOUBLE) END AS land_value,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE p_retailprice * CAST(37 AS DOUBLE) END AS improvement_value,
  CASE WHEN p_partkey % 4 = 0 THEN 0 WHEN p_partkey % 9 = 0 THEN NULL ELSE 1900 + CAST(p_size AS INT) END AS year_built,
  CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'Residential' WHEN 1 THEN 'TOWN HOUSE lot' WHEN 2 THEN 'Commercial' ELSE NULL END AS land_use,
  CAST((p_partkey * 37) % 1009 AS DOUBLE) AS shore_dist_m,
  CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE CAST((p_partkey * 31) % 601 AS DOUBLE) / CAST(10 AS DOUBLE) END AS drive_i68_min,
  CAST((p_partkey * 17) % 401 AS DOUBLE) / CAST(10 AS DOUBLE) AS drive_honi_min,
  CAST((p_partkey * 13) % 301 AS DOUBLE) / CAST(10 AS DOUBLE) AS drive_wisp_min,
  CAST((p_partkey * 11) % 201 AS DOUBLE) / CAST(10 AS DOUBLE) AS drive_grocery_min,
  CAST((p_partkey * 7) % 701 AS DOUBLE) / CAST(10 AS DOUBLE) AS drive_hospital_min
FROM {part}
"""
#: Grid cells of parcels; a fifth of the parcels has none, its cells are the
#: neighbour's.  Solid angles are sevenths, so that no mean of them is halfway
#: between two roundings.
CELLS = """
SELECT CAST(CASE WHEN l_partkey % 5 = 3 THEN l_partkey - 1 ELSE l_partkey END AS BIGINT) AS parcel_idx, l_quantity * CAST(1000 AS DOUBLE) AS area_2m, l_quantity * CAST(1500 AS DOUBLE) AS area_8m,
  l_discount / CAST(7 AS DOUBLE) AS solid_2m, (l_discount + l_tax) / CAST(7 AS DOUBLE) AS solid_8m, l_discount * CAST(200 AS DOUBLE) AS slope
FROM {lineitem}
"""
LISTINGS = """
SELECT CAST(p_partkey AS BIGINT) AS pos,
  CASE WHEN p_partkey % 7 = 0 THEN 'nowhere ' || CAST(p_partkey AS VARCHAR(20)) WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'far off ' || p_name ELSE ' ' || upper(p_name) || '.' END AS address,
  CASE WHEN p_partkey % 10 = 0 THEN '' ELSE '$' || CAST(CAST(floor(p_retailprice) AS INT) AS VARCHAR(20)) || ',000' END AS price,
  'u' || CAST(p_partkey AS VARCHAR(20)) AS url
FROM {part}
"""
#: A raster of one row per vector, scaled to metres.
GRID = """
SELECT CAST(vec_id AS INT) AS row, CAST(pos AS INT) AS col, CAST(z AS DOUBLE) * CAST(100 AS DOUBLE) AS z FROM {cells}
"""
POINTS = """
SELECT CAST(c_custkey AS BIGINT) AS id, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 9973 AS DOUBLE) AS y FROM {customer}
"""
NODES = """
SELECT CAST(s_suppkey AS BIGINT) AS id, CAST((s_suppkey * 6007) % 10007 AS DOUBLE) AS x, CAST((s_suppkey * 3001) % 9973 AS DOUBLE) AS y FROM {supplier}
"""

#: Directed roads with classes and some limits, one per line of an order.
EDGES = """
SELECT CAST(l_suppkey AS BIGINT) AS src, CAST((l_partkey * 7) % 101 AS BIGINT) AS dst, l_quantity * CAST(100 AS DOUBLE) AS length_m,
  CASE CAST(l_linenumber AS INT) WHEN 1 THEN 'primary' WHEN 2 THEN 'residential' WHEN 3 THEN 'track' WHEN 4 THEN 'path' ELSE 'service' END AS highway,
  CASE WHEN l_linenumber = 3 AND l_orderkey % 3 = 0 THEN CAST(30 AS DOUBLE) WHEN l_orderkey % 5 = 0 AND l_linenumber = 1 THEN CAST(90 AS DOUBLE) END AS maxspeed_kph
FROM {lineitem}
"""
#: Streets of many short pieces: the lines of an order lead from one crossing to
#: another, or round in a ring of their own; two of three orders both ways.
STREETS = """
SELECT CASE WHEN k = 1 AND NOT ring THEN o % 97 WHEN k = 1 THEN 1000 + o * 8 ELSE 999 + o * 8 + k END AS src,
  CASE WHEN k = m AND NOT ring THEN (o * 7) % 101 WHEN k = m THEN 1000 + o * 8 ELSE 1000 + o * 8 + k END AS dst, length_m, highway, o % 3 <> 0 AS both_ways
FROM (SELECT CAST(l_orderkey AS BIGINT) AS o, CAST(l_linenumber AS BIGINT) AS k, CAST(max(l_linenumber) OVER (PARTITION BY l_orderkey) AS BIGINT) AS m, l_orderkey % 10 = 0 AS ring,
  l_quantity * CAST(100 AS DOUBLE) AS length_m, CASE CAST(l_linenumber % 3 AS INT) WHEN 1 THEN 'tertiary' WHEN 2 THEN 'residential' END AS highway FROM {lineitem}) l
"""
#: The same as directed edges.
LANES = """
SELECT src, dst, length_m, highway FROM {streets} s UNION ALL SELECT dst AS src, src AS dst, length_m, highway FROM {streets} t WHERE both_ways
"""
#: Polygons around suppliers, edge by edge: octagons of many sizes, some with a
#: hole, some smaller than a cell; larger ones overlap.  Corners are exact.
SHAPES = """
SELECT CAST(s_suppkey AS INT) AS poly, ring, pos, x + r * dx AS x1, y + r * dy AS y1, x + r * ex AS x2, y + r * ey AS y2 FROM (
  SELECT s_suppkey, ring, CAST((s_suppkey * 6007) % 10007 + 1000 AS DOUBLE) AS x, CAST((s_suppkey * 3001) % 9973 + 1000 AS DOUBLE) AS y,
    CAST(CASE WHEN s_suppkey % 7 = 0 THEN 20 ELSE 60 + (s_suppkey * 53) % 300 END AS DOUBLE) / CAST(1 + ring AS DOUBLE) AS r
  FROM {supplier}, (VALUES (0), (1)) AS h(ring) WHERE ring = 0 OR s_suppkey % 5 = 0) s,
  (VALUES (0, 2, 1, 1, 2), (1, 1, 2, -1, 2), (2, -1, 2, -2, 1), (3, -2, 1, -2, -1), (4, -2, -1, -1, -2), (5, -1, -2, 1, -2), (6, 1, -2, 2, -1), (7, 2, -1, 2, 1)) AS c(pos, dx, dy, ex, ey)
"""


def fill(text: str, **names: str) -> str:
    """SQL for DuckDB: names in braces replaced, the table's own by default."""
    return re.sub(r"\{(\w+)\}", lambda m: names.get(m[1], m[1]), text)


def view(spark: SparkSession, folder: str, text: str, **frames: DataFrame) -> DataFrame:
    """The same text over Parquet tables of ``folder`` or given frames."""
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text.replace("VARCHAR(20)", "STRING"), **{n: frames[n] if n in frames else table(spark, folder, n) for n in names})


def grid(spark: SparkSession, folder: str) -> DataFrame:
    cells = table(spark, folder, "embeddings").selectExpr("vec_id", "posexplode(embedding) AS (pos, z)")
    return view(spark, folder, GRID, cells=cells)


def lanes(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, LANES, streets=view(spark, folder, STREETS))


LANES_SQL = fill(LANES, streets=f"({fill(STREETS)})")
SHAPES_SQL = fill(SHAPES)
GRID_SQL = fill(GRID, cells="(SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS z FROM embeddings)")
