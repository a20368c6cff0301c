"""Spatial joins and measures over points, polygons and lattices.

Polygons are edge tables (poly, x1, y1, x2, y2) with all rings of a polygon;
inside is decided by the parity of crossings, so holes need no treatment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.geo import crosses, segment_square
from ridgeline.operators.space import nearest_items
from ridgeline.session import cut, importable

#: Stretches that an edge of average length is searched by.
STRETCHES = 4
#: Points of a tile that one task counts, and that it counts among.
CROWD = 200_000
#: Points, and polygons, of a touched tile that meet in one task, and numbers of
#: a matrix of points by edges.
TILE, MATRIX = 4000, 1 << 21
#: Points of lines that are thinned together.
POINTS = 200_000
#: Polygons of either kind whose distances one task measures.
PAIRED = 1000, 2000


def edges(rings: DataFrame, poly: str, ring: str) -> DataFrame:
    """Edge table from closed rings, arrays of (x, y) structs."""
    n = F.size(ring)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b")))
    out = rings.where(n > 1).select(F.col(poly).alias("poly"), F.explode(pairs).alias("e"))
    return out.select("poly", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def boxes(edge: DataFrame) -> DataFrame:
    """Bounding box per polygon."""
    return edge.groupBy("poly").agg(
        F.least(F.min("x1"), F.min("x2")).alias("bx1"), F.least(F.min("y1"), F.min("y2")).alias("by1"),
        F.greatest(F.max("x1"), F.max("x2")).alias("bx2"), F.greatest(F.max("y1"), F.max("y2")).alias("by2"),
    )


def bounds(points: DataFrame, margin: float, step: float, more: DataFrame | None = None) -> DataFrame:
    """Box around all points, and those of ``more``, widened and snapped
    outward to a grid."""
    if more is not None:
        points = points.select("x", "y").union(more.select("x", "y"))
    lo = lambda c: (F.floor((F.min(c) - margin) / step) * step).cast("double")
    hi = lambda c: (F.ceil((F.max(c) + margin) / step) * step).cast("double")
    return points.agg(lo("x").alias("x1"), lo("y").alias("y1"), hi("x").alias("x2"), hi("y").alias("y2"))


def contains(points: DataFrame, edge: DataFrame, id_col: str = "id", cell: float = 1000.0) -> DataFrame:
    """(id, poly) for points (id, x, y) inside polygons.

    Space is cut into square tiles.  A tile of a polygon's box that no edge
    touches is inside or outside as a whole, which its centre decides.  Only
    points in touched tiles meet edges, and of these only the ones in their own
    band of tiles, so that a polygon of many edges or points is no single key.
    """
    return decided(points.select(F.col(id_col).alias("id"), "x", "y"), edge, cell).withColumnRenamed("id", id_col)


def decided(p: DataFrame, edge: DataFrame, cell: float = 1000.0) -> DataFrame:
    """``contains`` for points (id, x, y); where both tables have a group ``g``
    only those of one group meet.

    The points of a touched tile meet its polygons in one task, ``TILE`` of
    either at most, and pairs are not shuffled.
    """
    importable(p.sparkSession)
    by = ["g"] if "g" in p.columns and "g" in edge.columns else []
    tiles = _Tiles(edge, cell)
    p = p.select("id", *by, "x", "y").where("x IS NOT NULL AND y IS NOT NULL").withColumn("tx", F.floor(F.col("x") / cell)).withColumn("ty", F.floor(F.col("y") / cell))
    keys = [*by, "tx", "ty"]
    rim = tiles.rim.join(edge.select("poly", *by).distinct(), "poly") if by else tiles.rim
    share = F.ceil(F.count("*") / TILE).cast("int")
    shares = cut(p.groupBy(*keys).agg(share.alias("mine")).join(rim.groupBy(*keys).agg(share.alias("theirs")), keys))  # a row per tile
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    a = p.join(shares, keys).withColumn("a", dealt("id", "mine")).withColumn("b", every("theirs")).drop("mine", "theirs")
    sides = tiles.bands.where("y1 <> y2").select("poly", "ty", "x1", "y1", "x2", "y2")
    b = rim.join(shares, keys).withColumn("b", dealt("poly", "theirs")).withColumn("a", every("mine")).drop("mine", "theirs").join(sides, ["poly", "ty"])

    def run(points: pa.Table, some: pa.Table) -> pa.Table:
        point, poly = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        codes = some.column("poly").combine_chunks().dictionary_encode()
        if len(points) and len(some):
            code = codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            e = np.stack([some.column(c).to_numpy()[order] for c in ("x1", "y1", "x2", "y2")])
            first = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) > 0]))
            x, y = points.column("x").to_numpy(), points.column("y").to_numpy()
            n = max(1, MATRIX // len(code))
            for at in range(0, len(x), n):
                i, j = np.nonzero(np.bitwise_xor.reduceat(hits(x[at : at + n], y[at : at + n], e), first, axis=1))
                point.append(at + i)
                poly.append(j)
        point, poly = np.concatenate(point), np.concatenate(poly)
        return pa.table({"id": points.column("id").cast(_nullable(points.schema.field("id").type)).take(pa.array(point)), "poly": codes.dictionary.take(pa.array(poly))})

    keys = [*keys, "a", "b"]
    kinds = f"id {p.schema['id'].dataType.simpleString()}, poly {edge.schema['poly'].dataType.simpleString()}"
    near = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, kinds)
    whole = tiles.whole()
    if by:
        whole = whole.join(edge.select("poly", *by).distinct(), "poly")
    return p.join(whole, [*by, "tx", "ty"]).select("id", "poly").union(near)


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type as Spark's own text has it: fields of a struct may be null."""
    return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind]) if pa.types.is_struct(kind) else kind


def hits(x: np.ndarray, y: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which of the edges (x1, y1, x2, y2), none of them level, cross the ray
    from each point to the right (``geo.crosses``): one row per point."""
    x1, y1, x2, y2 = e
    x, y = x[:, None], y[:, None]
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)


class _Tiles:
    """Square tiles of polygons: ``rim`` (tx, ty, poly), those that edges touch."""

    def __init__(self, edge: DataFrame, cell: float):
        self.edge, self.cell = edge, cell
        self.bands = edge.withColumn("ty", F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))))
        self.rim = touched(edge, cell, 1e-6).select(F.col("col").cast("long").alias("tx"), F.col("row").cast("long").alias("ty"), "poly")

    def inside(self, at: DataFrame, keys: list[str], without: DataFrame | None = None) -> DataFrame:
        """Keys of rows (keys, x, y, ty, poly) that lie in their polygon."""
        hit = at.join(self.bands, ["poly", "ty"]).where(crosses(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2"))))
        if without is not None:
            hit = hit.join(without.select("id", "sid"), ["id", "sid"], "left_anti")
        return hit.groupBy(*keys).agg(F.count("*").alias("n")).where("n % 2 = 1").select(*keys)

    def whole(self) -> DataFrame:
        """(tx, ty, poly) of tiles inside a polygon that no edge touches."""
        tile = lambda c: F.floor(F.col(c) / self.cell)
        span = boxes(self.edge).select("poly", F.explode(F.sequence(tile("bx1"), tile("bx2"))).alias("tx"), F.sequence(tile("by1"), tile("by2")).alias("tys"))
        span = span.select("poly", "tx", F.explode("tys").alias("ty")).join(self.rim, ["tx", "ty", "poly"], "left_anti")
        centres = span.withColumn("x", (F.col("tx") + 0.5) * self.cell).withColumn("y", (F.col("ty") + 0.5) * self.cell)
        return self.inside(centres, ["tx", "ty", "poly"])


def inside_any(points: DataFrame, edge: DataFrame, id_col: str = "id") -> DataFrame:
    """``points`` with ``inside``: whether one of the polygons holds them.  The
    union of polygons is not drawn; being in it is being in one of them."""
    held = _held(points.select(F.col(id_col).alias("id"), "x", "y"), edge).select(F.col("id").alias(id_col)).withColumn("inside", F.lit(True))
    return points.join(held, id_col, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def _held(p: DataFrame, edge: DataFrame, cell: float | None = None) -> DataFrame:
    """(id) of points (id, x, y) inside some polygon.  Tiles are, by default, so
    small that boxes of polygons have sixteen on average.  Of the tiles that lie in a polygon
    as a whole, one is enough for the points in it; only the others meet edges."""
    box = F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1")
    if cell is None:
        mean = boxes(edge).agg(F.avg(box[0] * box[1])).first()[0]
        cell = (mean / 16) ** 0.5 if mean else 1000.0
    tiles = _Tiles(edge, cell)
    p = p.withColumn("tx", F.floor(F.col("x") / cell)).withColumn("ty", F.floor(F.col("y") / cell))
    full = cut(tiles.whole().select("tx", "ty").distinct().withColumn("full", F.lit(True)))
    p = cut(p.join(full, ["tx", "ty"], "left"))
    near = tiles.inside(p.where("full IS NULL").join(tiles.rim, ["tx", "ty"]), ["id", "poly"])
    return p.where("full").select("id").union(near.select("id")).distinct()


def within(points: DataFrame, edge: DataFrame, distance: float, id_col: str = "id", cell: float | None = None) -> DataFrame:
    """Ids of points in the polygons widened by ``distance``: inside one, or
    that near to an edge; if it is negative, in the polygons drawn in by it:
    inside one and farther than that from every edge."""
    inner = _held(points.select(F.col(id_col).alias("id"), "x", "y"), edge, cell).select(F.col("id").alias(id_col))
    near = boundary_distance(points, edge, id_col, reach=abs(distance)).select(id_col)
    return inner.union(near).distinct() if distance >= 0 else inner.join(near, id_col, "left_anti")


def snap_to_cells(points: DataFrame, res: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """``points`` with ``row`` and ``col`` of their cell, and x and y moved to
    its centre; rows and columns count from (x0, y0)."""
    out = points.withColumn("col", F.floor((F.col("x") - x0) / res).cast("int")).withColumn("row", F.floor((F.col("y") - y0) / res).cast("int"))
    return out.withColumn("x", x0 + (F.col("col") + 0.5) * res).withColumn("y", y0 + (F.col("row") + 0.5) * res)


def sample_points(edge: DataFrame, cells: DataFrame, step: float, res: float, inset: float) -> DataFrame:
    """(row, col, x, y) of a lattice over the polygons drawn in by ``inset``,
    on cells (row, col) of theirs, moved to the centres of these."""
    pts = lattice(bounds(edge.selectExpr("stack(2, x1, y1, x2, y2) AS (x, y)"), -inset, 1.0), step).withColumn("id", F.struct("x", "y"))
    kept = within(pts, edge, -inset).select("id.x", "id.y")
    return snap_to_cells(kept, res).join(cells.select("row", "col").distinct(), ["row", "col"], "left_semi").select("row", "col", "x", "y")


def rasterise(cells: DataFrame, edge: DataFrame, cell: float = 1000.0) -> DataFrame:
    """(row, col, zone) of cells (row, col, x, y) whose centre lies in a
    polygon; where polygons overlap, the largest id - the last - wins."""
    keyed = cells.withColumn("id", F.struct("row", "col"))
    got = contains(keyed, edge, "id", cell).groupBy("id").agg(F.max("poly").alias("zone"))
    return got.select("id.row", "id.col", "zone")


def touched(edge: DataFrame, res: float = 1.0, room: float = 0.0) -> DataFrame:
    """(row, col, poly) of the cells that a polygon's edges touch, their borders
    included, or come as near as ``room`` cells to; cell (r, c) covers [c, c + 1]
    x [r, r + 1] times ``res``.

    An edge touches a cell whose box it reaches and whose corners are not all on
    one side of it; no place along the edge is computed, so that corners on an
    edge are found exactly.
    """
    lo = lambda a, b: F.ceil(F.least(a, b) / res - room) - 1
    hi = lambda a, b: F.floor(F.greatest(a, b) / res + room)
    e = edge.select("poly", "x1", "y1", "x2", "y2")
    e = e.withColumn("col", F.explode(F.sequence(lo("x1", "x2"), hi("x1", "x2")))).withColumn("row", F.explode(F.sequence(lo("y1", "y2"), hi("y1", "y2"))))
    left, right, low, high = ((F.col(c) + d) * res for c, d in (("col", -room), ("col", 1 + room), ("row", -room), ("row", 1 + room)))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sides = [dx * (y - F.col("y1")) - dy * (x - F.col("x1")) for x in (left, right) for y in (low, high)]
    meets = (F.greatest("x1", "x2") >= left) & (F.least("x1", "x2") <= right) & (F.greatest("y1", "y2") >= low) & (F.least("y1", "y2") <= high)
    meets = meets & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)
    return e.where(meets).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "poly").distinct()


def fill_missing(zones: DataFrame, edge: DataFrame, res: float = 1.0) -> DataFrame:
    """``zones`` plus, for polygons that got no cell, the free cells that they
    touch; the last of these polygons wins."""
    missing = edge.join(zones.select(F.col("zone").alias("poly")).distinct(), "poly", "left_anti")
    patch = touched(missing, res).groupBy("row", "col").agg(F.max("poly").alias("zone"))
    return zones.unionByName(patch.join(zones, ["row", "col"], "left_anti"))


def lattice(box: DataFrame, step: float) -> DataFrame:
    """Points every ``step`` from the floor of the box's lower corner."""
    xs = F.expr(f"sequence(0, int(floor((x2 - floor(x1)) / {step})))")
    ys = F.expr(f"sequence(0, int(floor((y2 - floor(y1)) / {step})))")
    out = box.select(F.floor("x1").alias("ox"), F.floor("y1").alias("oy"), F.explode(xs).alias("i"), ys.alias("js"))
    out = out.select("ox", "oy", "i", F.explode("js").alias("j"))
    return out.select((F.col("ox") + F.col("i") * step).cast("double").alias("x"), (F.col("oy") + F.col("j") * step).cast("double").alias("y"))


def boundary_distance(points: DataFrame, edge: DataFrame, id_col: str = "id", reach: float | None = None) -> DataFrame:
    """Smallest distance from each point to a polygon's edges; with ``reach``
    only for points no farther than that.

    Stretches of edges are dealt to parts of space, and every point meets those
    whose boxes can hold its nearest one (``space.nearest_items``).
    """
    items = edge.select(*[F.col(c).alias("e" + c) for c in ("x1", "y1", "x2", "y2")], F.lit(0).cast("long").alias("none")).distinct()
    long = F.hypot(F.col("ex2") - F.col("ex1"), F.col("ey2") - F.col("ey1"))
    mean = items.agg(F.avg(long)).first()[0] or 1.0
    # a box for every stretch of an edge, with some room; on average no more than STRETCHES and one
    n = F.greatest(F.lit(1), F.ceil(long / (mean / STRETCHES))).cast("int")
    items = items.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    end = lambda c, i: F.col(f"e{c}1") + (F.col(f"e{c}2") - F.col(f"e{c}1")) * (F.col("i") + i) / F.col("n")
    room = mean * 1e-9
    box = [(f(end(c, 0), end(c, 1)) + d).alias(n) for f, d, c, n in ((F.least, -room, "x", "x1"), (F.least, -room, "y", "y1"), (F.greatest, room, "x", "x2"), (F.greatest, room, "y", "y2"))]
    square = segment_square(*map(F.col, ("x", "y", "ex1", "ey1", "ex2", "ey2")))
    out = nearest_items(points.select(F.col(id_col).alias("id"), "x", "y"), items.select("*", *box).drop("n", "i"), square, "none")
    out = out.select(F.col("id").alias(id_col), F.sqrt("m.d2").alias("distance"))
    return out if reach is None else out.where(F.col("distance") <= reach)


def polygon_distance(left: DataFrame, right: DataFrame, reach: float, once: bool = False) -> DataFrame:
    """(a, b, distance) of polygons from two edge tables that are no farther
    apart than ``reach``; 0 if they meet.  With ``once`` only pairs with a < b
    are measured, as of one table with itself.

    Edges of disjoint polygons are nearest at an end of one of them; meeting
    is an edge crossing or a first vertex inside the other polygon.  Polygons
    meet in the square tiles that both boxes touch, one of them widened by
    ``reach``, and a pair is measured in the one tile that holds the lower
    corner of what their boxes share; at most ``PAIRED`` of either kind are one
    task's, and pairs are not shuffled.
    """
    importable(left.sparkSession)
    size = boxes(left.select("poly", "x1", "y1", "x2", "y2").union(right.select("poly", "x1", "y1", "x2", "y2"))).agg(F.avg(F.greatest(F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1")))).first()[0]
    side = max(float(reach), size or 0.0) or 1.0

    def dealt(edge: DataFrame, n: str, wide: float) -> DataFrame:
        e = edge.groupBy("poly").agg(
            F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias(n + "e"),
            *[(g(f(c + "1"), f(c + "2")) + d).alias(n + c + k) for c in "xy" for f, g, d, k in ((F.min, F.least, -wide, "1"), (F.max, F.greatest, wide, "2"))],
        )
        tiles = lambda c: F.sequence(F.floor(F.col(n + c + "1") / side), F.floor(F.col(n + c + "2") / side))
        return e.withColumnRenamed("poly", n).withColumn("tx", F.explode(tiles("x"))).withColumn("ty", F.explode(tiles("y")))

    a, b, keys = cut(dealt(left, "a", 0.0)), cut(dealt(right, "b", reach)), ["tx", "ty"]
    share = lambda most: F.ceil(F.count("*") / most).cast("int")
    shares = cut(a.groupBy(*keys).agg(share(PAIRED[0]).alias("mine")).join(b.groupBy(*keys).agg(share(PAIRED[1]).alias("theirs")), keys))  # a row per tile
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = a.join(shares, keys).withColumn("i", part("a", "mine")).withColumn("j", every("theirs")).drop("mine", "theirs")
    b = b.join(shares, keys).withColumn("j", part("b", "theirs")).withColumn("i", every("mine")).drop("mine", "theirs")
    keys = [*keys, "i", "j"]

    def run(key: tuple, some: pa.Table, others: pa.Table) -> pa.Table:
        i, j, d = _apart(_Many(some, "a"), _Many(others, "b"), side, (key[0].as_py(), key[1].as_py()), reach, once)
        return pa.table({"a": some.column("a").take(pa.array(i)), "b": others.column("b").take(pa.array(j)), "distance": d})

    kind = lambda df: df.schema["poly"].dataType.simpleString()
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, f"a {kind(left)}, b {kind(right)}, distance double")


class _Many:
    """Polygons of a task: boxes, and edges of polygon i from ``first[i]``, ``n[i]``
    of them."""

    def __init__(self, table: pa.Table, name: str):
        self.box = np.stack([table.column(name + c).to_numpy() for c in ("x1", "y1", "x2", "y2")])
        held = table.column(name + "e").combine_chunks()
        self.n = np.diff(held.offsets.to_numpy())
        self.first = np.cumsum(self.n) - self.n
        flat = held.flatten()
        self.e = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")])
        self.id = table.column(name).to_numpy()
        low, high = np.minimum(self.e[:2], self.e[2:]), np.maximum(self.e[:2], self.e[2:])
        self.edge = np.concatenate([low, high])  # boxes of edges
        self.own = np.concatenate([np.minimum.reduceat(low, self.first, axis=1), np.maximum.reduceat(high, self.first, axis=1)]) if len(self.n) else self.edge


def _apart(a: _Many, b: _Many, side: float, tile: tuple[int, int], reach: float, once: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of polygons no farther apart than ``reach`` whose pair
    belongs to a tile; the boxes of ``b`` are widened by that."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(a.n), 64):
        box = a.box[:, at : at + 64, None]
        low, high = np.maximum(box[:2], b.box[:2, None]), np.minimum(box[2:], b.box[2:, None])
        mine = (low <= high).all(axis=0) & (np.floor(low[0] / side) == tile[0]) & (np.floor(low[1] / side) == tile[1])
        i, j = np.nonzero(mine & (a.id[at : at + 64, None] < b.id) if once else mine)
        i += at
        near = _gap(a.own[:, i], b.own[:, j]) <= reach * reach * (1 + 1e-9)
        i, j = i[near], j[near]
        for s in _runs(a.n[i] + b.n[j], 1 << 16):  # what a processor's cache holds
            d = _distances(a, b, i[s], j[s])
            near = d <= reach
            found.append((i[s][near], j[s][near], d[near]))
    return tuple(np.concatenate(v) for v in zip(*found))


def _each(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners and places of ``n`` things each, and where each owner begins."""
    first = np.cumsum(n) - n
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(len(own)) - first[own], first


def _gap(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Squared distances of boxes (x1, y1, x2, y2)."""
    d = np.maximum(0.0, np.maximum(one[:2] - two[2:], two[:2] - one[2:]))
    return d[0] * d[0] + d[1] * d[1]


def _nearest_corner(one: _Many, k: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A polygon's corner that is nearest to a place, and its squared distance."""
    own, at, first = _each(one.n[k])
    e = one.first[k][own] + at
    d = (one.e[0][e] - x[own]) ** 2 + (one.e[1][e] - y[own]) ** 2
    least = np.minimum.reduceat(d, first)
    hit = np.flatnonzero(d == least[own])
    hit = hit[np.concatenate([[True], np.diff(own[hit]) > 0])]
    return e[hit], least


def _facing(one: _Many, k: np.ndarray, two: _Many, m: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of polygons that are as near to the other one's box as ``bound``:
    these, pair by pair, and how many of each pair before and in it."""
    own, at, _ = _each(one.n[k])
    e = one.first[k][own] + at
    near = _gap(one.edge[:, e], two.own[:, m][:, own]) <= bound[own]
    n = np.bincount(own[near], minlength=len(k))
    return e[near], np.cumsum(n) - n, n


def _distances(a: _Many, b: _Many, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of pairs of polygons; 0 if they meet."""
    if not len(i):
        return np.zeros(0)
    # no edges are nearer than their boxes; corners are no nearer than polygons
    corner, _ = _nearest_corner(a, i, *((b.own[c] + b.own[c + 2])[j] / 2 for c in (0, 1)))
    bound = _nearest_corner(b, j, a.e[0][corner], a.e[1][corner])[1] * (1 + 1e-9)
    mine, begin, n = _facing(a, i, b, j, bound)
    theirs, start, width = _facing(b, j, a, i, bound)
    own, at, first = _each(n * width)
    p, q = mine[begin[own] + at // width[own]], theirs[start[own] + at % width[own]]
    some = np.flatnonzero(_gap(a.edge[:, p], b.edge[:, q]) <= bound[own])
    own, A, B = own[some], a.e[:, p[some]], b.e[:, q[some]]
    square = np.minimum.reduce([_square(*A[:2], B), _square(*A[2:], B), _square(*B[:2], A), _square(*B[2:], A)])
    turn = lambda e, x, y: np.sign((e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0]))
    square[(turn(A, *B[:2]) * turn(A, *B[2:]) < 0) & (turn(B, *A[:2]) * turn(B, *A[2:]) < 0)] = 0.0
    out = np.sqrt(np.minimum.reduceat(square, np.flatnonzero(np.concatenate([[True], np.diff(own) > 0]))))
    for one, k, two, m in ((a, i, b, j), (b, j, a, i)):
        # a corner inside a polygon lies in its box
        x, y, box = one.e[0][one.first[k]], one.e[1][one.first[k]], two.own[:, m]
        apart = np.flatnonzero((out > 0) & (box[0] <= x) & (x <= box[2]) & (box[1] <= y) & (y <= box[3]))
        x, y = one.e[0][one.first[k[apart]]], one.e[1][one.first[k[apart]]]
        own, at, first = _each(two.n[m[apart]])
        if len(own):
            e = two.e[:, two.first[m[apart]][own] + at]
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = ((e[1] > y[own]) != (e[3] > y[own])) & (x[own] < (e[2] - e[0]) * (y[own] - e[1]) / (e[3] - e[1]) + e[0])
            out[apart[np.add.reduceat(hit.astype(np.int64), first) % 2 == 1]] = 0.0
    return out


def _square(x: np.ndarray, y: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared distances from points to edges (``geo.segment_square``)."""
    dx, dy = e[2] - e[0], e[3] - e[1]
    length = dx * dx + dy * dy
    t = np.clip(((x - e[0]) * dx + (y - e[1]) * dy) / np.where(length > 0, length, 1.0), 0.0, 1.0)
    ex, ey = x - (e[0] + t * dx), y - (e[1] + t * dy)
    return ex * ex + ey * ey


def nearest_polygon(left: DataFrame, right: DataFrame, cell: float = 1000.0) -> DataFrame:
    """(a, b, distance): for each polygon of ``left`` the nearest of ``right``,
    ties to the lowest; polygons without one in reach try again with a reach
    four times as wide."""
    ends = [F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))]
    p, q = left.agg(*ends).first(), right.agg(*ends).first()
    if None in (*p, *q):
        return polygon_distance(left, right, cell).limit(0)
    span = max(p[1], q[1]) - min(p[0], q[0]) + max(p[3], q[3]) - min(p[2], q[2])
    todo, parts = left, []
    while True:
        found = polygon_distance(todo, right, cell).groupBy("a").agg(F.min(F.struct("distance", "b")).alias("m"))
        parts.append(cut(found.select("a", "m.b", "m.distance")))
        if cell >= span:
            break
        todo = cut(todo.join(parts[-1].select(F.col("a").alias("poly")), "poly", "left_anti"))
        if todo.isEmpty():
            break
        cell *= 4
    return reduce(DataFrame.union, parts)


def count_within(points: DataFrame, radius: float, id_col: str = "id") -> DataFrame:
    """Per point, how many points (itself too) are nearer than ``radius``.

    Points are dealt to square tiles of that side and, by the tiles around
    theirs, to those that they can lie near to; crowded tiles are shared out, at
    most ``CROWD`` points of either kind to a task (``_counted``).
    """
    importable(points.sparkSession)
    p = points.select(F.col(id_col).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    p = p.withColumn("tx", F.floor(F.col("x") / radius)).withColumn("ty", F.floor(F.col("y") / radius))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    tiles = cut(p.groupBy("tx", "ty").agg(F.count("*").alias("n")))  # a row per tile
    beside = tiles.select("n", "tx", "ty", around.alias("o")).groupBy((F.col("tx") + F.col("o.i")).alias("tx"), (F.col("ty") + F.col("o.j")).alias("ty")).agg(F.sum("n").alias("m"))
    share = lambda c: F.ceil(F.col(c) / CROWD).cast("int")
    tiles = cut(tiles.join(beside, ["tx", "ty"]).select("tx", "ty", share("n").alias("mine"), share("m").alias("theirs")))
    a = p.join(tiles, ["tx", "ty"]).withColumn("a", F.pmod(F.xxhash64("id"), F.col("mine")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)))
    q = p.select(F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"), "tx", "ty", around.alias("o")).select("qid", "qx", "qy", (F.col("tx") + F.col("o.i")).alias("tx"), (F.col("ty") + F.col("o.j")).alias("ty"))
    b = q.join(tiles, ["tx", "ty"]).withColumn("b", F.pmod(F.xxhash64("qid"), F.col("theirs")).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("mine") - 1)))

    def run(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": some.id, "n": _counted(some.x.to_numpy(), some.y.to_numpy(), others.qx.to_numpy(), others.qy.to_numpy(), radius)})

    keys = ["tx", "ty", "a", "b"]
    kind = points.schema[id_col].dataType.simpleString()
    out = a.select("id", "x", "y", *keys).groupBy(*keys).cogroup(b.select("qx", "qy", *keys).groupBy(*keys)).applyInPandas(run, f"id {kind}, n long")
    return out.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", id_col)


def _counted(x: np.ndarray, y: np.ndarray, qx: np.ndarray, qy: np.ndarray, radius: float) -> np.ndarray:
    """For each (x, y) the number of (qx, qy) nearer than ``radius``.

    The latter lie in level strips, sorted by x.  A disc holds one stretch of a
    strip for certain and cannot reach beyond a wider one; only what lies between
    the two is measured.
    """
    out = np.zeros(len(x), np.int64)
    if not len(x) or not len(qx):
        return out
    strip = np.floor((qy - qy.min()) * (min(400, 1 + len(qx) // 64) / max(qy.max() - qy.min(), 1e-300))).astype(np.int64)
    order = np.lexsort((qx, strip))
    qx, qy, strip = qx[order], qy[order], strip[order]
    first = np.flatnonzero(np.concatenate([[True], strip[1:] != strip[:-1]]))
    square = radius * radius
    for a, b in zip(first, np.append(first[1:], len(qx))):
        xs, low, high = qx[a:b], qy[a:b].min(), qy[a:b].max()
        near, far = np.maximum(0.0, np.maximum(low - y, y - high)), np.maximum(np.abs(low - y), np.abs(high - y))
        some = np.flatnonzero(near < radius)
        px, py = x[some], y[some]
        wide = np.sqrt(np.maximum(square - near[some] ** 2, 0.0)) + radius * 1e-9
        sure = np.sqrt(np.maximum(square - far[some] ** 2, 0.0)) - radius * 1e-9
        i, l = np.searchsorted(xs, px - wide), np.searchsorted(xs, px + wide, side="right")
        j, k = np.searchsorted(xs, px - sure), np.searchsorted(xs, px + sure, side="right")
        none = sure <= 0
        j, k = np.where(none, l, np.clip(j, i, l)), np.where(none, l, np.clip(k, i, l))
        out[some] += k - j
        count = (j - i) + (l - k)
        for s in _runs(count, 1 << 21):
            n = count[s]
            own = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            head = (j - i)[s][own]
            at = a + np.where(at < head, i[s][own] + at, k[s][own] + at - head)
            dx, dy = px[s][own] - qx[at], py[s][own] - qy[at]
            out[some[s]] += np.bincount(own[dx * dx + dy * dy < square], minlength=len(n))
    return out


def _runs(count: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of ``count`` whose sums are about ``most``, one at least."""
    upto, start = np.cumsum(count), 0
    while start < len(count):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, side="right")))
        yield slice(start, end)
        start = end


def nearest(points: DataFrame, nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, node, d2): the nearest node of every point; ties go to the lowest.

    Nodes, one for each place, are dealt to parts of space, and every point
    meets those whose boxes can hold its nearest one (``space.nearest_items``).
    """
    items = nodes.where("x IS NOT NULL AND y IS NOT NULL").groupBy(F.col("x").alias("x1"), F.col("y").alias("y1")).agg(F.min("id").alias("node"))
    dx, dy = F.col("x") - F.col("x1"), F.col("y") - F.col("y1")
    items = items.select("node", "x1", "y1", F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    out = nearest_items(points.select(F.col(id_col).alias("id"), "x", "y"), items, dx * dx + dy * dy, "node")
    return out.select(F.col("id").alias(id_col), "m.node", "m.d2")


def simplify(lines: DataFrame, id_col: str, tolerance: float) -> DataFrame:
    """Douglas-Peucker per line: rows (id, pos, x, y) that stay.

    Lines are thinned together, some ``POINTS`` at a time, as most have few points.
    """
    importable(lines.sparkSession)
    cols = lines.select(id_col, "pos", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, most = [], 0, POINTS
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < most:
                continue
            t = pa.Table.from_batches(held)
            if end := int(_begun(t)[-1]):  # the last line may go on
                yield from _thinned(t.slice(0, end), tolerance)
                t = t.slice(end)
            held, rows = t.to_batches(), len(t)
            most = max(POINTS, 2 * rows)
        if rows:
            yield from _thinned(pa.Table.from_batches(held), tolerance)

    return cols.repartition(id_col).sortWithinPartitions(id_col, "pos").mapInArrow(run, cols.schema)


def _begun(t: pa.Table) -> np.ndarray:
    """Where lines begin, in rows that are sorted by line."""
    code = t.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], np.diff(code) != 0]))


def _thinned(t: pa.Table, tolerance: float) -> list[pa.RecordBatch]:
    """Whole lines (id, pos, x, y), thinned all at once: a round looks at every
    stretch that is left."""
    x, y = t.column("x").to_numpy(), t.column("y").to_numpy()
    a = _begun(t)
    b = np.append(a[1:], len(x)) - 1
    keep = np.zeros(len(x), bool)
    keep[a] = keep[b] = True
    while len(a := a[(some := b - a >= 2)]):
        b = b[some]
        nth, k, first = _each(b - a - 1)
        i, s, e = a[nth] + 1 + k, a[nth], b[nth]
        dx, dy, px, py = x[e] - x[s], y[e] - y[s], x[i] - x[s], y[i] - y[s]
        n = (dx * dx + dy * dy) ** 0.5
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(n > 0, abs(px * dy - py * dx) / n, (px * px + py * py) ** 0.5)
        far = np.maximum.reduceat(d, first)
        far_off = far > tolerance
        at = np.flatnonzero((d == far[nth]) & far_off[nth])
        _, one = np.unique(nth[at], return_index=True)  # the first of equal ones
        m = i[at[one]]
        keep[m] = True
        a, b = np.concatenate([a[far_off], m]), np.concatenate([m, b[far_off]])
    return t.take(pa.array(np.flatnonzero(keep))).to_batches()


def representative_point(edge: DataFrame) -> DataFrame:
    """A point inside each polygon: the middle of the widest stretch of a scan
    line halfway between two vertex heights near the middle of the box."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        ys = sorted(set(pdf.y1) | set(pdf.y2))
        mid = (ys[0] + ys[-1]) / 2
        below = max((v for v in ys if v <= mid), default=ys[0])
        above = min((v for v in ys if v > mid), default=ys[-1])
        y = (below + above) / 2
        xs = sorted((b.x2 - b.x1) * (y - b.y1) / (b.y2 - b.y1) + b.x1 for b in pdf.itertuples() if (b.y1 > y) != (b.y2 > y))
        best = max(zip(xs[::2], xs[1::2]), key=lambda s: s[1] - s[0], default=(pdf.x1.iloc[0], pdf.x1.iloc[0]))
        return pd.DataFrame({"poly": [pdf.poly.iloc[0]], "x": [(best[0] + best[1]) / 2], "y": [y]})

    kind = edge.schema["poly"].dataType.simpleString()
    return edge.groupBy("poly").applyInPandas(pick, f"poly {kind}, x double, y double")
