"""Drive times: edge speeds and reverse multi-source shortest paths."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions.scalar import round_even
from ridgeline.operators.chains import ranked
from ridgeline.operators.space import placed, split
from ridgeline.session import cut, importable

#: Nodes of a region, whose searches run in one task.
PER_REGION = 20_000
#: Ends of edges that one task joins to chains.
PER_TASK = 1_000_000
#: Nodes of many roads, or classes of roads, that are sent to all tasks.
MOST_SENT = 500_000
#: Ways through a node that are listed one by one, and nodes whose times are a
#: matrix of a task.
MOST_WAYS, MOST_DENSE = 256, 4000

#: Speeds in km/h by road class where no limit is tagged.
SPEEDS = {
    "motorway": 105,
    "motorway_link": 55,
    "trunk": 90,
    "trunk_link": 50,
    "primary": 75,
    "primary_link": 45,
    "secondary": 65,
    "secondary_link": 40,
    "tertiary": 55,
    "tertiary_link": 35,
    "residential": 35,
    "living_street": 20,
    "unclassified": 40,
    "service": 20,
}
FALLBACK = 35
#: Fixed value: real drive times against speed limits.
TIME_FACTOR = 1.40


def travel_times(edges: DataFrame) -> DataFrame:
    """``edges`` (highway, maxspeed_kph, length_m) with ``speed_kph`` and
    ``travel_s``: the tagged limit, else the table, else the mean of tagged
    edges of the class, else the fallback."""
    table = F.create_map(*[F.lit(x) for kv in SPEEDS.items() for x in kv])
    mean = cut(edges.groupBy("highway").agg(F.avg("maxspeed_kph").alias("__mean")))
    mean = F.broadcast(mean) if mean.count() <= MOST_SENT else mean  # edges dealt by class would be a few tasks' work
    speed = F.coalesce("maxspeed_kph", F.try_element_at(table, F.col("highway")).cast("double"), F.col("__mean"), F.lit(float(FALLBACK)))
    out = edges.join(mean, "highway", "left").withColumn("speed_kph", speed).drop("__mean")
    return out.withColumn("travel_s", F.col("length_m") / (F.col("speed_kph") / 3.6))


def shortest(edges: DataFrame, sources: DataFrame, at: DataFrame | None = None, per_region: int = PER_REGION, most_rounds: int = 10_000) -> DataFrame:
    """(dest, node, seconds): least time from each node to the nearest of a
    destination's nodes (dest, node), along edges (src, dst, travel_s).

    With the places of nodes, ``at`` (id, x, y), the graph is cut into regions
    of about ``per_region`` nodes.  Searches within a region give the times from
    where roads enter it to where they leave it; over these the destinations'
    times spread in the same way, until few enough nodes are left for one
    region; from the entries a second search reaches all nodes of a region.
    Without places, or where regions have mostly entries, nodes pass times on to
    their neighbours, a step further each round.  Rounds are written out, so that
    lost executors cost one round; no task holds more than a region.
    """
    back = cut(edges.where("src <> dst").groupBy(F.col("dst").alias("node"), F.col("src").alias("next")).agg(F.min("travel_s").alias("w")))
    starts = sources.select("dest", F.col("node").cast("long").alias("node")).where("node IS NOT NULL").distinct().withColumn("seconds", F.lit(0.0))
    return _over(back, starts, at, per_region, most_rounds)


def _over(back: DataFrame, starts: DataFrame, at: DataFrame | None, per_region: int, most_rounds: int) -> DataFrame:
    """(dest, node, seconds) from ``starts``, which have times, over roads
    (node, next, w)."""
    nodes = lambda df: df.select("node").union(df.select("next")).distinct()
    n = nodes(back).count()
    if n <= per_region:
        return _inward(back.withColumn("region", F.lit(0)), starts.withColumn("region", F.lit(0)))
    if at is None:
        return _spread(starts, back.select("node", "next", "w"), most_rounds)
    at = cut(at.join(nodes(back).withColumnRenamed("node", "id"), "id", "left_semi"))
    parts = split(at, per_region, compact=True)
    shared = at.sparkSession.sparkContext.broadcast(parts)
    region = cut(at.where("x IS NOT NULL AND y IS NOT NULL").select("id", placed(shared)("x", "y").alias("region")))
    of = lambda df, c, n: df.join(region.select(F.col("id").alias(c), F.col("region").alias(n)), c, "left").withColumn(n, F.coalesce(n, F.lit(-1)))
    roads = cut(of(of(back, "node", "region"), "next", "to"))
    inner, across = roads.where("region = to"), cut(roads.where("region <> to"))
    starts = of(starts, "node", "region")
    asked = across.select(F.col("to").alias("region"), F.col("next").alias("node"), F.lit(None).cast("string").alias("dest")).distinct()
    asked = asked.union(starts.select("region", "node", "dest")).withColumn("leaves", F.lit(False))
    asked = asked.union(across.select("region", "node", F.lit(None).cast("string"), F.lit(True)).distinct())
    # roads are few bytes and much work, so their size says nothing about the tasks they need
    tasks = int(back.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked, within = (df.repartition(tasks, "region") for df in (asked, inner))
    through = asked.groupBy("region").cogroup(within.groupBy("region")).applyInPandas(_through, "dest string, node long, leaves long, seconds double")
    step = across.select(F.col("node").alias("leaves"), F.col("next").alias("enters"), "w")
    hops = cut(through.join(step, "leaves").groupBy("dest", "node", "enters").agg(F.min(F.col("seconds") + F.col("w")).alias("w")))
    first = hops.join(starts.select("dest", "node", "seconds"), ["dest", "node"]).groupBy("dest", F.col("enters").alias("node")).agg(F.min(F.col("seconds") + F.col("w")).alias("seconds"))
    above = cut(hops.where("dest IS NULL").select("node", F.col("enters").alias("next"), "w"))
    fewer = 2 * nodes(above).count() <= n
    best = _over(above, cut(first), at, per_region, most_rounds) if fewer else _spread(first, above, most_rounds)
    return _inward(inner, starts.unionByName(of(best, "node", "region")))


def _spread(starts: DataFrame, hops: DataFrame, most_rounds: int) -> DataFrame:
    """(dest, node, seconds) from ``starts`` over hops (node, next, w); only
    what improved in the last round goes on."""
    best = front = cut(starts.select("dest", "node", "seconds"))
    for _ in range(most_rounds):
        reach = front.join(hops, "node").groupBy("dest", F.col("next").alias("node")).agg(F.min(F.col("seconds") + F.col("w")).alias("via"))
        both = cut(best.join(reach, ["dest", "node"], "full").withColumn("new", F.col("via").isNotNull() & (F.col("seconds").isNull() | (F.col("via") < F.col("seconds")))))
        best = both.select("dest", "node", F.when(F.col("new"), F.col("via")).otherwise(F.col("seconds")).alias("seconds"))
        front = both.where("new").select("dest", "node", F.col("via").alias("seconds"))
        if front.isEmpty():
            return best
    raise RuntimeError(f"paths did not settle in {most_rounds} rounds")


class _Roads:
    """The roads (node, next, w) of one region, by node."""

    def __init__(self, roads: pd.DataFrame):
        self.out: dict[int, list[tuple[int, float]]] = {}
        for a, b, w in zip(roads.node.tolist(), roads.next.tolist(), roads.w.tolist()):
            self.out.setdefault(a, []).append((b, w))

    def search(self, starts: list[tuple[float, int]]) -> dict[int, float]:
        best: dict[int, float] = {}
        heap = sorted(starts)
        while heap:
            t, n = heapq.heappop(heap)
            if n not in best:
                best[n] = t
                for m, w in self.out.get(n, ()):
                    if m not in best:
                        heapq.heappush(heap, (t + w, m))
        return best


def _through(asked: pd.DataFrame, roads: pd.DataFrame) -> pd.DataFrame:
    """Times (dest, node, leaves, seconds) from each place that is asked for to
    where roads leave a region."""
    leaves = set(asked.node[asked.leaves].tolist())
    starts = list(zip(asked.dest[~asked.leaves].tolist(), asked.node[~asked.leaves].tolist()))
    out, found = _passed(roads, leaves | {n for _, n in starts}), []
    held = sorted(leaves | {n for _, n in starts} | set(out))
    if len(held) <= MOST_DENSE:
        number = {n: i for i, n in enumerate(held)}
        times = np.full((len(held), len(held)), np.inf)
        for n, row in out.items():
            times[number[n], [number[m] for m in row]] = list(row.values())
        ends = sorted(number[n] for n in leaves)
        kept = sorted({*ends, *(number[n] for _, n in starts)})
        _settle(times, np.array(kept, int))
        for dest, n in starts:
            t = times[number[n], ends]
            found += [(dest, n, held[ends[k]], float(t[k])) for k in np.flatnonzero(np.isfinite(t))]
    else:
        graph = _Roads(pd.DataFrame([(n, m, w) for n, row in out.items() for m, w in row.items()], columns=["node", "next", "w"]))
        for dest, n in starts:
            found += [(dest, n, m, t) for m, t in graph.search([(0.0, n)]).items() if m in leaves]
    return pd.DataFrame(found, columns=["dest", "node", "leaves", "seconds"])


def _passed(roads: pd.DataFrame, kept: set[int]) -> dict[int, dict[int, float]]:
    """Roads, by node, with the same least times between ``kept`` nodes: other
    nodes go, those with the fewest ways through first, and leave a road for
    each way, as long as there are no more than ``MOST_WAYS``."""
    out: dict[int, dict[int, float]] = {}
    into: dict[int, dict[int, float]] = {}
    for a, b, w in zip(roads.node.tolist(), roads.next.tolist(), roads.w.tolist()):
        out.setdefault(a, {})[b] = into.setdefault(b, {})[a] = w
        out.setdefault(b, {}), into.setdefault(a, {})
    heap = [(len(into[n]) * len(out[n]), n) for n in out if n not in kept]
    heapq.heapify(heap)
    while heap:
        ways, n = heapq.heappop(heap)
        if n not in out or ways != len(into[n]) * len(out[n]):
            continue  # another entry has what it became
        if ways > MOST_WAYS:
            break
        before, after = into.pop(n), out.pop(n)
        for a in before:
            del out[a][n]
        for b in after:
            del into[b][n]
        for a, v in before.items():
            row = out[a]
            for b, w in after.items():
                if a != b and v + w < row.get(b, np.inf):
                    row[b] = into[b][a] = v + w
        for m in {*before, *after} - kept:
            heapq.heappush(heap, (len(into[m]) * len(out[m]), m))
    return out


def _settle(times: np.ndarray, kept: np.ndarray) -> None:
    """Least times between ``kept`` nodes, in place, of a matrix of roads (infinite
    where there is none): other nodes go, those with the fewest roads first."""
    roads, left = np.isfinite(times).sum(axis=1), np.ones(len(times), bool)
    left[kept] = False
    for _ in range(int(left.sum())):
        n = int(np.where(left, roads, np.iinfo(np.int64).max).argmin())
        left[n] = False
        before, after = np.flatnonzero(np.isfinite(times[:, n])), np.flatnonzero(np.isfinite(times[n]))
        both = np.ix_(before, after)
        times[both] = np.minimum(times[both], times[before, n][:, None] + times[n, after])
        times[n], times[:, n] = np.inf, np.inf
        roads[before] = np.isfinite(times[before]).sum(axis=1)
    some = times[np.ix_(kept, kept)]
    np.fill_diagonal(some, 0.0)
    for n in range(len(kept)):
        np.minimum(some, some[:, n, None] + some[n], out=some)
    times[np.ix_(kept, kept)] = some


def _inward(roads: DataFrame, starts: DataFrame) -> DataFrame:
    """(dest, node, seconds) within each region, from starts with their times."""
    importable(roads.sparkSession)

    def run(known: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        graph, out = _Roads(some), []
        for dest, own in known.groupby("dest", dropna=False):
            best = graph.search(list(zip(own.seconds.tolist(), own.node.tolist())))
            out.append(pd.DataFrame({"dest": dest, "node": list(best), "seconds": list(best.values())}))
        return pd.concat(out) if out else pd.DataFrame({"dest": [], "node": [], "seconds": []})

    return starts.groupBy("region").cogroup(roads.groupBy("region")).applyInPandas(run, "dest string, node long, seconds double")


def clip(nodes: DataFrame, edges: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Edges (src, dst) of which one end (id, x, y) at least lies in the box
    (x1, y1, x2, y2), borders included."""
    inside = nodes.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])).select(F.col("id"))
    a = edges.join(inside.withColumnRenamed("id", "src").withColumn("__a", F.lit(True)), "src", "left")
    a = a.join(inside.withColumnRenamed("id", "dst").withColumn("__b", F.lit(True)), "dst", "left")
    return a.where("__a OR __b").select(*edges.columns)


def simplify(edges: DataFrame, sums: list[str], sets: Sequence[str] = ()) -> DataFrame:
    """``edges`` (src, dst, ...) with every chain over nodes that a road only
    passes as one edge: (src, dst, ``sums``, ``sets``, parts).  Such a node has
    two neighbours and one edge to or from each, in a one-way road, or one of
    either kind; parallel edges and loops end a road.  Nodes are whole numbers;
    null ones end a road too.

    Columns of ``sums`` are summed along the chain, those of ``sets`` become the
    sorted distinct values that are not null, and ``parts`` counts the edges.
    Either direction of a road is a chain of its own.  A chain that returns to its
    beginning is a loop there; a ring without any other node begins and ends at
    its smallest one.  Least sums between the nodes that stay are the same as
    before.

    Nodes of more than four ends are known by counting; they are never passed.
    All other ends of edges go to the task of their range of nodes, ``PER_TASK``
    ends to a task, where chains are joined as far as it has their nodes; only
    the pieces of chains that go on elsewhere are ranked and shuffled again.
    Where neighbours' numbers are far apart these are all edges.
    """
    importable(edges.sparkSession)
    kinds = {f.name: f.dataType for f in edges.schema.fields}
    added = [F.col(c).cast("long" if isinstance(kinds[c], T.IntegralType) else "double").alias(c) for c in sums]
    e = cut(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), *added, *sets).withColumn("eid", F.monotonically_increasing_id()))
    busy = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).groupBy("node").agg(F.count("*").alias("n")).where("n > 4 AND node IS NOT NULL").select("node"))
    n, few = e.count(), F.broadcast if busy.count() <= MOST_SENT else lambda df: df
    for c in ("src", "dst"):
        e = e.join(few(busy.select(F.col("node").alias(c), F.lit(True).alias(f"busy_{c}"))), c, "left").withColumn(f"busy_{c}", F.coalesce(f"busy_{c}", F.lit(False)))
    alone = e.where("busy_src AND busy_dst").select("src", "dst", *sums, *[F.array_compact(F.array(c)).alias(c) for c in sets], F.lit(1).cast("long").alias("parts"))
    # an edge's values go with its beginning, or where that is busy with its end
    there = e.where("NOT busy_src").select(F.col("src").alias("node"), F.col("dst").alias("other"), "eid", F.lit(True).alias("out"), F.col("busy_dst").alias("busy"), *sums, *sets)
    ends = there.union(e.where("NOT busy_dst").select("dst", "src", "eid", F.lit(False), "busy_src", *[F.when(F.col("busy_src"), F.col(c)).alias(c) for c in (*sums, *sets)]))
    near = ends.repartitionByRange(1 + 2 * n // PER_TASK, "node")
    values = ", ".join([f"`{c}` {e.schema[c].dataType.simpleString()}" for c in sums] + [f"`{c}` array<{e.schema[c].dataType.simpleString()}>" for c in sets])
    pieces = cut(near.mapInArrow(_joined(tuple(sums), tuple(sets)), f"src long, dst long, {values}, parts long, id long, prev long, low long, whole boolean"))
    out = ["src", "dst", *sums, *sets, "parts"]
    open_ = pieces.where("NOT whole")
    places = ranked(open_.select("id", "prev", F.col("low").alias("node")))
    every = open_.join(places, "id").groupBy("first", "ring").agg(
        F.min_by("src", "span").alias("src"), F.max_by("dst", "span").alias("dst"), F.min("low").alias("low"), *[F.sum(c).alias(c) for c in sums],
        *[F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets], F.sum("parts").alias("parts"),
    )
    at = lambda c: F.when(F.col("ring"), F.col("low")).otherwise(F.col(c)).alias(c)
    chains = pieces.where("whole").select(*out).union(every.select(at("src"), at("dst"), *out[2:]))
    chains = chains.withColumns({c: F.nullif(F.col(c), F.lit(_NO_NODE)) for c in ("src", "dst")}).union(alone)
    return chains.withColumns({c: F.col(c).cast(kinds[c]) for c in ("src", "dst")})


#: Stands for a null node within a task.
_NO_NODE = -(2**63)


def _joined(sums: tuple[str, ...], sets: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Joins the edges of a task's ends (node, other, eid, out, busy, values),
    whose ``other`` may be ``busy``, to pieces of chains: (src, dst, ``sums``,
    ``sets``, parts, id, prev, low, whole).

    Edges' values count where they begin, as far as is known here.  A piece is ``whole`` if
    it begins and ends here or is a ring; another one has the number of its last
    edge, doubled, with one added where its chain ends, and the number before it
    where its first edge comes from another task.  ``low`` is its least node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        t = pa.Table.from_batches(some).combine_chunks()
        ints = lambda c: pc.fill_null(t.column(c), _NO_NODE).to_numpy()
        node, other, out, busy = ints("node"), ints("other"), t.column("out").to_numpy(), t.column("busy").to_numpy()
        eids, edge = np.unique(t.column("eid").to_numpy(), return_inverse=True)
        held, n = out | busy, len(eids)
        own, values = edge[held], t.filter(pa.array(held))
        src, dst, before = np.empty(n, np.int64), np.empty(n, np.int64), _before(node, other, edge, out, n)
        src[edge], dst[edge] = np.where(out, node, other), np.where(out, other, node)
        leaves, arrives, follows = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        leaves[own], arrives[edge[~out | busy]] = True, True
        follows[before[before >= 0]] = True
        # steps of 1, 2, 4 ... back, until all are at a beginning or have been round
        every = np.arange(n)
        first, least = np.where(before < 0, every, before), every
        for _ in range(n.bit_length() + 1):
            far = first[first]
            if (far == first).all():
                break
            least, first = np.minimum(least, least[first]), far
        ring = before[first] >= 0
        names, piece = np.unique(np.where(ring, least, first), return_inverse=True)
        last, m = names.copy(), len(names)
        last[piece[~follows]] = np.flatnonzero(~follows)
        round_ = ring[names]
        low = np.full(m, np.iinfo(np.int64).max)
        np.minimum.at(low, piece[own], node[held])
        begins, ends = leaves[names], arrives[last]
        cols = {"src": np.where(round_, low, src[names]), "dst": np.where(round_, low, dst[last])}
        cols |= {c: _sum_by(values.column(c), piece[own], m) for c in sums} | {c: _set_by(values.column(c), piece[own], m) for c in sets}
        prev = pa.array(2 * eids[names], mask=begins | round_)
        cols |= {"parts": np.bincount(piece[own], minlength=m), "id": 2 * eids[last] + ends, "prev": prev, "low": low, "whole": round_ | (begins & ends)}
        yield from pa.table(cols).to_batches(max_chunksize=50_000)

    return run


def _before(node: np.ndarray, other: np.ndarray, edge: np.ndarray, out: np.ndarray, n: int) -> np.ndarray:
    """Per edge the one before it over a node that is only passed, or -1."""
    _, code = np.unique(node, return_inverse=True)
    count = np.bincount(code)
    outs = np.bincount(code, out)
    never = np.bincount(code, (node == other) | (node == _NO_NODE) | (other == _NO_NODE)) > 0
    fit = ((count == 2) | (count == 4)) & (2 * outs == count) & ~never
    before = np.full(n, -1)
    for k in (2, 4):  # one way or both ways
        rows = np.flatnonzero((fit & (count == k))[code])
        rows = rows[np.lexsort((other[rows], out[rows], code[rows]))].reshape(-1, k)
        o, e = other[rows], edge[rows]
        if k == 2:
            e = e[o[:, 0] != o[:, 1]]
            before[e[:, 1]] = e[:, 0]
        else:
            e = e[(o[:, 0] != o[:, 1]) & (o[:, 0] == o[:, 2]) & (o[:, 1] == o[:, 3])]
            before[e[:, 2]], before[e[:, 3]] = e[:, 1], e[:, 0]
    return before


def _sum_by(values: pa.ChunkedArray, key: np.ndarray, m: int) -> pa.Array:
    """Sums by key below ``m``; null where there is no value."""
    known = pc.is_valid(values).to_numpy()
    v = pc.fill_null(values, 0).to_numpy()
    total = np.zeros(m, v.dtype)
    np.add.at(total, key, v)
    return pa.array(total, mask=np.bincount(key[known], minlength=m) == 0)


def _set_by(values: pa.ChunkedArray, key: np.ndarray, m: int) -> pa.Array:
    """Sorted distinct values by key below ``m``."""
    known = pc.is_valid(values).to_numpy()
    names = pc.unique(values.drop_null())
    names = names.take(pc.sort_indices(names))
    code = pc.index_in(values, value_set=names).drop_null().to_numpy()
    both = np.unique(key[known] * max(1, len(names)) + code)
    at = np.searchsorted(both, np.arange(m + 1) * max(1, len(names)))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), names.take(pa.array(both % max(1, len(names)))))


def largest_component(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``edges`` of the connected component, regardless of direction, with the
    most nodes; of equals the one with the smallest node.

    Each round takes the least label among neighbours and then the label of
    that label, so that long chains shorten by doubling.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = cut(both.union(both.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("next"), F.col("label").alias("was"))
        hop = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        new = cut(step.join(hop, F.col("next") == F.col("at"), "left").select("node", F.least("next", "far").alias("label"), "was"))
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    best = labels.groupBy("label").agg(F.count("*").alias("n")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    kept = labels.join(F.broadcast(best), "label").select(F.col("node").alias("src"))  # one row
    return edges.join(kept, "src", "left_semi")


def minutes(parcels: DataFrame, times: DataFrame, dests: list[str]) -> DataFrame:
    """One column per destination: calibrated minutes to one decimal from each
    parcel's node, null where there is no way."""
    m = round_even(F.col("seconds") / 60.0 * TIME_FACTOR, 1)
    wide = times.groupBy("node").pivot("dest", dests).agg(F.first(m))
    out = parcels.join(wide, "node", "left")
    return out.select(*parcels.columns, *[F.col(d).alias(f"drive_{d}_min") for d in dests])
