"""Queries over parcels: scoring, zones, linkage, scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import scalar as S
from ridgeline.operators import linkage, ranking, render, zonal
from ridgeline.plans.standins import CELLS, LISTINGS, PARCELS, fill, view
from ridgeline.session import table

DESTINATIONS = [("i68", "I-68"), ("honi", "Honi"), ("wisp", "Wisp"), ("grocery", "Grocery"), ("hospital", "Hospital")]
MEASURES = {"area_2m": "area_2m", "area_8m": "area_8m", "solid_2m": "solid_2m", "solid_8m": "solid_8m"}


def parcels(spark: SparkSession, folder: str) -> DataFrame:
    """Parcels with view statistics, usable land and listings."""
    base, cells = view(spark, folder, PARCELS), view(spark, folder, CELLS)
    ids = base.select("parcel_idx")
    stats = zonal.zonal(cells, ids, "parcel_idx", MEASURES)
    for eye in ("2m", "8m"):
        stats = stats.withColumn(f"area_{eye}_p90_ac", S.round_even(S.acres(F.col(f"area_{eye}_p90")), 1))
    land = zonal.usable(cells, ids, "parcel_idx", "slope")
    listed = linkage.attach_listings(base, view(spark, folder, LISTINGS), "address", "pos")
    return listed.join(stats, "parcel_idx").join(land, "parcel_idx")


def _q(x: str, digits: int) -> str:
    return f"(round_even(({x}) * 1e{digits}::DOUBLE, 0) / 1e{digits}::DOUBLE)"


_KEY = "trim(regexp_replace(upper(coalesce({}, '')), '[^A-Z0-9 ]', '', 'g'))"
_STATS = ", ".join(
    f"{_q(f'coalesce(avg({m}), 0)', 4)} AS {m}_mean, {_q(f'greatest(coalesce(max({m}), 0), 0)', 4)} AS {m}_max, {_q(f'coalesce(quantile_cont({m}, 0.9), 0)', 4)} AS {m}_p90"
    for m in MEASURES
)
PARCEL_SQL = f"""
base AS ({fill(PARCELS)}), cells AS ({fill(CELLS)}), listings AS ({fill(LISTINGS)}),
stats AS (SELECT b.parcel_idx, count(c.parcel_idx) AS cells, {_STATS},
  {_q("count(*) FILTER (WHERE c.slope <= 15) * 100.0::DOUBLE / 4046.86::DOUBLE", 2)} AS usable_acres,
  {_q("CASE WHEN count(c.slope) > 0 THEN count(*) FILTER (WHERE c.slope <= 15) / count(c.slope)::DOUBLE ELSE 0 END * 100", 1)} AS usable_pct
  FROM base b LEFT JOIN cells c ON b.parcel_idx = c.parcel_idx GROUP BY b.parcel_idx),
last AS (SELECT k, arg_max_null(price_value, pos) AS list_price, arg_max_null(url, pos) AS list_url FROM (
  SELECT {_KEY.format("address")} AS k, TRY_CAST(nullif(regexp_replace(price, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS price_value, url, pos FROM listings)
  WHERE k <> '' GROUP BY k),
parcels AS (SELECT b.*, l.list_price, l.list_url, s.* EXCLUDE (parcel_idx),
  {_q("s.area_2m_p90 / 4046.86::DOUBLE", 1)} AS area_2m_p90_ac, {_q("s.area_8m_p90 / 4046.86::DOUBLE", 1)} AS area_8m_p90_ac
  FROM base b JOIN stats s ON b.parcel_idx = s.parcel_idx LEFT JOIN last l ON {_KEY.format("b.address")} = l.k)
"""


def score_sql(eye: str, weights: dict[str, int], keep: str, k: int = 20) -> str:
    """The scoring query in DuckDB's SQL."""
    active = [m for m in ranking.metrics(eye, DESTINATIONS) if weights.get(m.id, 0) > 0]
    values = ", ".join(
        f"CASE WHEN {m.column} IS NOT NULL AND isfinite({m.column}::DOUBLE){' AND ' + m.column + ' > 0' if m.positive else ''} THEN {m.column}::DOUBLE END AS v_{m.id}" for m in active
    )
    ranks = ", ".join(
        f"CASE WHEN v_{m.id} IS NULL THEN NULL WHEN count(v_{m.id}) OVER () <= 1 THEN 0.5 ELSE "
        f"((rank() OVER (ORDER BY v_{m.id} NULLS LAST) - 1) * 2 + count(*) OVER (PARTITION BY v_{m.id}) - 1)::DOUBLE / 2.0::DOUBLE / (count(v_{m.id}) OVER () - 1) END AS p_{m.id}"
        for m in active
    )
    u = {m.id: f"100.0::DOUBLE * ({'1 - ' if m.low_is_good else ''}p_{m.id})" for m in active}
    mean = " + ".join(f"{u[m.id]} * {weights[m.id]}.0::DOUBLE" for m in active) + ""
    total = sum(weights[m.id] for m in active)
    ok = " AND ".join(f"v_{m.id} IS NOT NULL" for m in active)
    return f"""
WITH {PARCEL_SQL}, vals AS (SELECT parcel_idx, cells, year_built, land_use, acres, {values} FROM parcels),
ranks AS (SELECT *, {ranks} FROM vals)
SELECT parcel_idx, floor(({mean}) / {total}.0::DOUBLE * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE AS score
FROM ranks WHERE cells > 0 AND {keep} AND {ok} ORDER BY score DESC, parcel_idx LIMIT {k}
"""


def _scored(preset: str, eye: str = "2m", residential: bool = False, min_acres: float = 0.0):
    weights, kind = ranking.PRESETS[preset], ranking.PRESET_FILTER.get(preset, "any")

    def run(spark: SparkSession, folder: str) -> DataFrame:
        keep = ranking.lot_filter(kind, residential, min_acres)
        out = ranking.score(parcels(spark, folder), "parcel_idx", ranking.metrics(eye, DESTINATIONS), weights, keep)
        return ranking.top(out, "parcel_idx").select("parcel_idx", "score")

    keep = {"any": "true", "vacant": "coalesce(year_built, 0) = 0", "improved": "coalesce(year_built, 0) <> 0"}[kind]
    if residential:
        keep += " AND regexp_matches(coalesce(land_use, ''), '(?i)Residential|Town House')"
    return run, score_sql(eye, weights, f"{keep} AND coalesce(acres, 0) >= {min_acres}")


def score_asking(spark: SparkSession, folder: str) -> DataFrame:
    out = ranking.score(parcels(spark, folder), "parcel_idx", ranking.metrics("2m", DESTINATIONS), {"asking": 100})
    return ranking.top(out, "parcel_idx").select("parcel_idx", "score", "list_price")


def score_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    registry = ranking.metrics("8m", DESTINATIONS)
    out = ranking.score(parcels(spark, folder), "parcel_idx", registry, ranking.PRESETS["view"], ranking.lot_filter())
    x = ranking.top(out, "parcel_idx").select("parcel_idx", F.explode("breakdown").alias("b"))
    return x.select("parcel_idx", "b.label", "b.value", S.round_even(F.col("b.utility"), 4).alias("utility"), "b.weight")


def _breakdown_sql() -> str:
    s = score_sql("8m", ranking.PRESETS["view"], "true")
    active = [m for m in ranking.metrics("8m", DESTINATIONS) if ranking.PRESETS["view"].get(m.id, 0) > 0]
    parts = " UNION ALL ".join(
        f"SELECT parcel_idx, '{m.label}' AS label, v_{m.id} AS value, {_q(f'100.0::DOUBLE * ({"1 - " if m.low_is_good else ""}p_{m.id})', 4)} AS utility, {ranking.PRESETS['view'][m.id]} AS weight FROM ranks WHERE parcel_idx IN (SELECT parcel_idx FROM best)"
        for m in active
    )
    head, tail = s.rsplit("\nSELECT parcel_idx, floor", 1)
    return f"{head}, best AS (SELECT parcel_idx, floor{tail})\n{parts}"


def score_no_weights(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.score(parcels(spark, folder), "parcel_idx", ranking.metrics("2m", DESTINATIONS), {}).select("parcel_idx", "score")


def midpoint_percentile(spark: SparkSession, folder: str) -> DataFrame:
    vals = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("metric"), F.floor(F.col("o_totalprice") / 100).cast("double").alias("v"))
    return ranking.midpoint_percentiles(vals).select("id", "metric", "v", S.round_even(F.col("p"), 9).alias("p"))


def upper_median(spark: SparkSession, folder: str) -> DataFrame:
    vals = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("metric"), F.col("o_totalprice").alias("v"))
    return ranking.upper_medians(vals)


def zonal_stats(spark: SparkSession, folder: str) -> DataFrame:
    ids = view(spark, folder, PARCELS).select("parcel_idx")
    return zonal.zonal(view(spark, folder, CELLS), ids, "parcel_idx", MEASURES)


def usable_share(spark: SparkSession, folder: str) -> DataFrame:
    ids = view(spark, folder, PARCELS).select("parcel_idx")
    return zonal.usable(view(spark, folder, CELLS), ids, "parcel_idx", "slope")


def layer_report(spark: SparkSession, folder: str) -> DataFrame:
    x = view(spark, folder, CELLS).selectExpr("stack(4, 'area_2m', area_2m, 'area_8m', area_8m, 'solid_2m', solid_2m, 'solid_8m', solid_8m) AS (layer, v)")
    out = zonal.layer_report(x, "layer", "v")
    return out.select("layer", *[S.round_even(F.col(c), 4).alias(c) for c in ("max_v", "mean_v", "nonzero_pct")])


def p98_scale(spark: SparkSession, folder: str) -> DataFrame:
    x = view(spark, folder, CELLS).selectExpr("stack(4, 'area', '2m', area_2m, 'area', '8m', area_8m, 'solid', '2m', solid_2m, 'none', '2m', -1D) AS (metric, eye, v)")
    return zonal.colour_scale(x, "metric", "eye", "v").select("metric", S.round_even(F.col("vmax"), 6).alias("vmax"))


def listing_join(spark: SparkSession, folder: str) -> DataFrame:
    out = linkage.attach_listings(view(spark, folder, PARCELS), view(spark, folder, LISTINGS), "address", "pos")
    return out.select("parcel_idx", "list_price", "list_url")


def listing_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return linkage.unmatched_listings(view(spark, folder, PARCELS), view(spark, folder, LISTINGS), "address").select("pos", "address", "url")


def listing_matches(spark: SparkSession, folder: str) -> DataFrame:
    out = linkage.attach_listings(view(spark, folder, PARCELS), view(spark, folder, LISTINGS), "address", "pos")
    return out.agg(F.count_if(F.col("list_url").isNotNull()).alias("matched"), F.count("*").alias("parcels"))


def join_by_position(spark: SparkSession, folder: str) -> DataFrame:
    base = view(spark, folder, PARCELS)
    return linkage.join_by_position(base.select("parcel_idx", "address"), base.select("parcel_idx", "drive_i68_min"), "parcel_idx")


def best_views(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.top(parcels(spark, folder), "parcel_idx", "area_2m_p90_ac", 5).select("parcel_idx", "area_2m_p90_ac")


def drive_report(spark: SparkSession, folder: str) -> DataFrame:
    cols = [f"drive_{d}_min" for d, _ in DESTINATIONS]
    x = view(spark, folder, PARCELS).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*cols))).alias("field", "v")).where(S.finite(F.col("v")))
    return x.groupBy("field").agg(F.min("v").alias("lo"), F.median("v").alias("mid"), F.max("v").alias("hi"), F.count("*").alias("n"))


def scalar_text(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return p.select(
        F.col("p_partkey").alias("id"), S.normalise_address(F.concat(F.lit("  12-"), "p_name", F.lit(" Rd. #4  "))).alias("addr"),
        S.parse_price(F.concat(F.lit("$ "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 7 == 0, F.lit(".1.2")).otherwise(F.lit(",000.5")))).alias("price"),
        F.col("p_type").rlike("(?i)residential|brass").alias("hit"), F.col("p_type").startswith("STANDARD").alias("starts"),
        F.split_part("p_type", F.lit(" "), F.lit(1)).alias("token"), S.year_of(F.lit("20240131")).alias("year"),
        S.number_or_null(F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.col("p_size").cast("string"))).alias("num"),
        S.minutes_label(F.col("p_size").cast("double")).alias("minutes"), S.metres_label(F.col("p_size").cast("double")).alias("metres"),
    )


def scalar_numbers(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").withColumn("v", F.col("o_totalprice") / 7)
    return o.select(
        F.col("o_orderkey").alias("id"), S.round_even(F.col("v"), 1).alias("even1"), S.round_up(F.col("v"), 1).alias("up1"),
        S.truncate(F.col("v")).alias("cut"), S.snap_down(F.col("v"), 10.0).cast("double").alias("down"), S.snap_up(F.col("v"), 10.0).cast("double").alias("up"),
        S.round_even(S.acres(F.col("v")), 6).alias("ac"), S.clamp_index(F.col("v") / 100, 500).alias("cell"),
        S.round_even(S.bearing(F.col("o_custkey") - 700.0, F.col("o_orderkey") % 1000 - 500.0), 6).alias("azimuth"),
    )


def azimuth_histogram(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    az = S.bearing(F.col("o_custkey") - 700.0, F.col("o_orderkey") % 1000 - 500.0)
    b = F.least(F.lit(12), F.width_bucket(az, F.lit(0.0), F.lit(360.0), F.lit(12).cast("int")))
    return o.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def tile_enumeration(spark: SparkSession, folder: str) -> DataFrame:
    box = table(spark, folder, "nation").agg(F.min(F.col("n_nationkey") / 7.0 + 38).alias("s"), F.max(F.col("n_nationkey") / 7.0 + 38).alias("n"))
    lat = box.select(F.explode(F.sequence(F.floor("s"), F.ceil("n") - 1)).alias("lat"))
    both = lat.select("lat", F.explode(F.sequence(F.lit(-80), F.lit(-78))).alias("lon"))
    return both.select(S.tile_name(F.col("lat"), F.col("lon")).alias("tile")).distinct().orderBy("tile")


def land_zones(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of zones in the mask, and usable land off the lake with a slope,
    which heeds no mask."""
    x = view(spark, folder, _FLAGGED)
    ids = view(spark, folder, PARCELS).select("parcel_idx")
    stats = zonal.zonal(x.where("mask AND parcel_idx IS NOT NULL"), ids, "parcel_idx", {"area_2m": "area_2m"})
    return stats.join(zonal.usable(x, ids, "parcel_idx", "slope", lake=F.col("lake")), "parcel_idx").select("parcel_idx", "cells", "area_2m_mean", "usable_acres", "usable_pct")


_FLAGGED = """
SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_partkey AS BIGINT) END AS parcel_idx, l_quantity * CAST(1000 AS DOUBLE) AS area_2m,
  CASE WHEN l_linenumber = 6 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 5 THEN NULL ELSE l_discount * CAST(200 AS DOUBLE) END AS slope,
  l_returnflag = 'R' AS lake, l_linestatus = 'O' AS mask
FROM {lineitem}
"""


def parcel_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Columns that a map keeps, then every drive time there is."""
    p = view(spark, folder, PARCELS)
    keep = ["parcel_idx", "address", "acres", "year_built", "shore_dist_m"]
    return p.select(*keep, *[c for c in p.columns if c.startswith("drive_")])


def parcel_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of a parcel's popup, with what stands for missing values."""
    p = view(spark, folder, PARCELS)
    return p.select(
        "parcel_idx", S.money(F.col("land_value")).alias("land"), S.money(F.col("improvement_value")).alias("improvements"),
        S.acres_label(F.coalesce("acres", F.lit(0.0))).alias("lot"), S.metres_label(F.coalesce("shore_dist_m", F.lit(0.0))).alias("shore"),
        F.coalesce(S.minutes_label(F.col("drive_i68_min")), F.lit("-")).alias("drive"), S.millisteradians_label((F.col("parcel_idx") % 1000 + 1) / 1024.0).alias("seen"),
        F.coalesce("land_use", F.lit("")).alias("use"), S.year_of(F.concat((F.col("parcel_idx") % 90 + 1930).cast("string"), F.lit("0131"))).alias("sold"),
    )


def score_colours(spark: SparkSession, folder: str) -> DataFrame:
    """The legend colour of every order's price on a linear ramp."""
    o = table(spark, folder, "orders")
    ends = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    c = render.stop_colour(F.col("o_totalprice"), F.col("lo"), F.col("hi"))
    return o.join(F.broadcast(ends)).select(F.col("o_orderkey").alias("id"), c.alias("c")).select("id", "c.*")  # one row


def score_messages(spark: SparkSession, folder: str) -> DataFrame:
    """What is said without weights, without candidates, and with some."""
    p, reg = parcels(spark, folder), ranking.metrics("2m", DESTINATIONS)
    none = ranking.lot_filter(min_acres=1e9)
    said = []
    for name, weights, keep in (("no weights", {}, None), ("no lots", {"shore": 1}, none), ("no listings", {"asking": 5}, none), ("some", {"shore": 1}, None)):
        out = ranking.score(p, "parcel_idx", reg, weights, keep)
        said.append(ranking.message(out, weights).select(F.lit(name).alias("name"), "text"))
    return reduce(DataFrame.union, said)


def score_reweighted(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked again with other weights: the same query, nothing remembered."""
    reg = ranking.metrics("2m", DESTINATIONS)
    out = ranking.score(parcels(spark, folder), "parcel_idx", reg, REWEIGHTED, ranking.lot_filter())
    return ranking.top(out, "parcel_idx").select("parcel_idx", "score")


REWEIGHTED = {"lot_size": 50, "shore": 30, "improvements": 20}


_AZ = "(((degrees(atan2(o_custkey - 700.0::DOUBLE, o_orderkey % 1000 - 500.0::DOUBLE))) % 360) + 360) % 360"
_UNPIVOT = "SELECT '{0}' AS field, drive_{0}_min AS v FROM ({1})"

SQL: dict[str, str] = {
    "score_asking": score_sql("2m", {"asking": 100}, "true").replace("cells > 0 AND true", "true").replace("SELECT parcel_idx, floor", "SELECT parcel_idx, v_asking AS list_price, floor"),
    "score_breakdown": _breakdown_sql(),
    "score_no_weights": "SELECT CAST(p_partkey AS BIGINT) AS parcel_idx, CAST(NULL AS DOUBLE) AS score FROM part WHERE false",
    "midpoint_percentile": f"""
WITH v AS (SELECT o_orderkey AS id, o_orderpriority AS metric, floor(o_totalprice / 100) AS v FROM orders)
SELECT id, metric, v, {_q("((rank() OVER (PARTITION BY metric ORDER BY v) - 1) * 2 + count(*) OVER (PARTITION BY metric, v) - 1)::DOUBLE / 2 / (count(*) OVER (PARTITION BY metric) - 1)", 9)} AS p FROM v""",
    "upper_median": "SELECT o_orderpriority AS metric, list_sort(list(o_totalprice))[(count(*) // 2) + 1] AS upper_median, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1",
    "zonal_stats": f"WITH {PARCEL_SQL} SELECT parcel_idx, cells, {', '.join(f'{m}_{p}' for m in MEASURES for p in ('mean', 'max', 'p90'))} FROM stats",
    "usable_share": f"WITH {PARCEL_SQL} SELECT parcel_idx, usable_acres, usable_pct FROM stats",
    "layer_report": " UNION ALL ".join(
        f"SELECT '{m}' AS layer, {_q(f'max({m})', 4)} AS max_v, {_q(f'avg({m})', 4)} AS mean_v, {_q(f'avg(CASE WHEN {m} > 0 THEN 1.0 ELSE 0.0 END) * 100', 4)} AS nonzero_pct FROM ({fill(CELLS)})" for m in MEASURES
    ),
    "p98_scale": f"""
WITH c AS ({fill(CELLS)}), x AS (SELECT 'area' AS metric, '2m' AS eye, area_2m AS v FROM c UNION ALL SELECT 'area', '8m', area_8m FROM c
  UNION ALL SELECT 'solid', '2m', solid_2m FROM c UNION ALL SELECT 'none', '2m', -1 FROM c)
SELECT metric, {_q("coalesce(max(s), 1)", 6)} AS vmax FROM (SELECT metric, eye, quantile_cont(v, 0.98) FILTER (WHERE v > 0) AS s FROM x GROUP BY ALL) GROUP BY metric""",
    "listing_join": f"WITH {PARCEL_SQL} SELECT parcel_idx, list_price, list_url FROM parcels",
    "listing_unmatched": f"WITH {PARCEL_SQL} SELECT pos, address, url FROM listings WHERE {_KEY.format('address')} NOT IN (SELECT {_KEY.format('address')} FROM base WHERE {_KEY.format('address')} <> '')",
    "listing_matches": f"WITH {PARCEL_SQL} SELECT CAST(count(list_url) AS BIGINT) AS matched, CAST(count(*) AS BIGINT) AS parcels FROM parcels",
    "join_by_position": f"SELECT parcel_idx, address, drive_i68_min FROM ({fill(PARCELS)})",
    "best_views": f"WITH {PARCEL_SQL} SELECT parcel_idx, area_2m_p90_ac FROM parcels ORDER BY area_2m_p90_ac DESC, parcel_idx LIMIT 5",
    "drive_report": "SELECT 'drive_' || field || '_min' AS field, min(v) AS lo, median(v) AS mid, max(v) AS hi, CAST(count(*) AS BIGINT) AS n FROM ("
    + " UNION ALL ".join(_UNPIVOT.format(d, fill(PARCELS)) for d, _ in DESTINATIONS)
    + ") WHERE v IS NOT NULL GROUP BY field",
    "scalar_text": """
SELECT p_partkey AS id, trim(regexp_replace(upper('  12-' || p_name || ' Rd. #4  '), '[^A-Z0-9 ]', '', 'g')) AS addr,
  TRY_CAST(regexp_replace('$ ' || p_size || CASE WHEN p_size % 7 = 0 THEN '.1.2' ELSE ',000.5' END, '[^0-9.]', '', 'g') AS DOUBLE) AS price,
  regexp_matches(p_type, '(?i)residential|brass') AS hit, starts_with(p_type, 'STANDARD') AS starts, split_part(p_type, ' ', 1) AS token, '2024' AS year,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size::DOUBLE END AS num, printf('%.1f', p_size::DOUBLE) || ' min' AS minutes,
  CASE WHEN p_size <= 15 THEN 'waterfront' ELSE p_size || ' m' END AS metres FROM part""",
    "scalar_numbers": f"""
WITH o AS (SELECT *, o_totalprice / 7 AS v FROM orders)
SELECT o_orderkey AS id, {_q("v", 1)} AS even1, floor(v * 10 + 0.5) / 10 AS up1, CAST(trunc(v) AS BIGINT) AS cut, floor(v / 10) * 10 AS down, ceil(v / 10) * 10 AS up,
  {_q("v / 4046.86::DOUBLE", 6)} AS ac, CAST(greatest(0, least(498, floor(v / 100))) AS INT) AS cell, {_q(_AZ, 6)} AS azimuth FROM o""",
    "azimuth_histogram": f"SELECT CAST(least(12, floor({_AZ} / 30) + 1) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1",
    "tile_enumeration": """
SELECT DISTINCT printf('n%02dw%03d', CAST(lat + 1 AS INT), CAST(abs(lon) AS INT)) AS tile FROM
  (SELECT unnest(range(CAST(floor(min(n_nationkey / 7.0 + 38)) AS BIGINT), CAST(ceil(max(n_nationkey / 7.0 + 38)) AS BIGINT))) AS lat FROM nation), (SELECT unnest([-80, -79, -78]) AS lon) ORDER BY tile""",
}
_STOPS = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(render.LEGEND)) + ") AS t(i, r, g, b))"
SQL |= {
    "land_zones": f"""
WITH b AS ({fill(PARCELS)}), x AS ({fill(_FLAGGED)}),
z AS (SELECT parcel_idx, count(*) AS cells, avg(area_2m) AS m FROM x WHERE mask AND parcel_idx IS NOT NULL GROUP BY 1),
u AS (SELECT parcel_idx, count(*) AS n, count(*) FILTER (WHERE slope <= 15) AS ok FROM x WHERE NOT lake AND slope IS NOT NULL AND NOT isnan(slope) GROUP BY 1)
SELECT b.parcel_idx, CAST(coalesce(cells, 0) AS BIGINT) AS cells, {_q("coalesce(m, 0)", 4)} AS area_2m_mean, {_q("coalesce(ok, 0) * 100.0::DOUBLE / 4046.86::DOUBLE", 2)} AS usable_acres,
  {_q("CASE WHEN n > 0 THEN ok / n::DOUBLE ELSE 0 END * 100", 1)} AS usable_pct
FROM b LEFT JOIN z USING (parcel_idx) LEFT JOIN u USING (parcel_idx)""",
    "parcel_columns": f"SELECT parcel_idx, address, acres, year_built, shore_dist_m, drive_i68_min, drive_honi_min, drive_wisp_min, drive_grocery_min, drive_hospital_min FROM ({fill(PARCELS)})",
    "parcel_labels": f"""
WITH p AS ({fill(PARCELS)}), v AS (SELECT *, (parcel_idx % 1000 + 1) / 1024.0::DOUBLE * 1000 AS s FROM p)
SELECT parcel_idx, CASE WHEN land_value = 0 THEN '-' ELSE '$' || format('{{:,}}', CAST(floor(land_value + 0.5) AS BIGINT)) END AS land,
  CASE WHEN improvement_value = 0 THEN '-' ELSE '$' || format('{{:,}}', CAST(floor(improvement_value + 0.5) AS BIGINT)) END AS improvements,
  CASE WHEN coalesce(acres, 0) < 10 THEN printf('%.2f', coalesce(acres, 0)) ELSE printf('%.1f', floor(acres * 10 + 0.5) / 10) END || ' ac' AS lot,
  CASE WHEN shore_dist_m <= 15 THEN 'waterfront' ELSE CAST(floor(shore_dist_m + 0.5) AS BIGINT) || ' m' END AS shore,
  coalesce(printf('%.1f', drive_i68_min) || ' min', '-') AS drive,
  CASE WHEN s < 1 THEN printf('%.3f', floor(s * 1000 + 0.5) / 1000) WHEN s < 10 THEN printf('%.2f', floor(s * 100 + 0.5) / 100) WHEN s < 100 THEN printf('%.1f', floor(s * 10 + 0.5) / 10) ELSE printf('%.0f', floor(s + 0.5)) END || ' msr' AS seen,
  coalesce(land_use, '') AS use, CAST(parcel_idx % 90 + 1930 AS VARCHAR) AS sold FROM v""",
    "score_colours": f"""
WITH o AS (SELECT o_orderkey AS id, (o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) AS t FROM orders)
SELECT id, r, g, b FROM o JOIN {_STOPS} s ON s.i = CAST(floor(t * t * 23 + 0.5) AS INT)""",
    "score_messages": "SELECT * FROM (VALUES ('no weights', 'No metric has a weight.'), ('no lots', 'No lot has a value for every weighted metric and passes the filters.'), ('no listings', 'No lot has a value for every weighted metric and passes the filters; only lots with a listing have an asking price.')) AS t(name, text)",
    "score_reweighted": score_sql("2m", REWEIGHTED, "true"),
}
_PLAIN = (
    land_zones, parcel_columns, parcel_labels, score_colours, score_messages, score_reweighted,
    score_asking, score_breakdown, score_no_weights, midpoint_percentile, upper_median, zonal_stats, usable_share, layer_report, p98_scale,
    listing_join, listing_unmatched, listing_matches, join_by_position, best_views, drive_report, scalar_text, scalar_numbers, azimuth_histogram, tile_enumeration,
)
QUERIES = {f.__name__: f for f in _PLAIN}
for _name, _args in {
    "score_balanced": ("balanced",), "score_view": ("view",), "score_vacant": ("vacant",), "score_home": ("home",), "score_access": ("access",),
    "score_view_8m_residential": ("view", "8m", True, 2.0),
}.items():
    QUERIES[_name], SQL[_name] = _scored(*_args)
