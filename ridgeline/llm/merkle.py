"""A Merkle manifest of a dataset, with a proof for every row.

Rows are leaves; those of a source form a tree, ascending by id, and the roots
of all sources another, ascending by source.  In a tree every ``ARITY``
consecutive nodes (the last run: fewer, even one) become their hash, until one
is left.  Because a tree's size is known, so is the length of every run.

A forest holds unresolved nodes keyed by tree, level and index.  Two forests
merge by union; whenever a run is complete its hash takes its place, one level
up.  That is associative and commutative, so every task reduces the leaves it
reads, ``LEAVES`` at once, and ``treeReduce`` merges what is left: of a contiguous
range of leaves at most ``ARITY`` - 1 nodes at either end of a level.  The merged
forest remembers the nodes that it resolved: some 4 for each level and
``LEAVES`` rows, about 10 KB.  It is sent to the tasks, which make proofs from it
and from their own leaves.

Defined results: a null id sorts before all others, a null source too; rows that
share an id are leaves of their own, in the order of their hashes; equal rows
are interchangeable; an empty table gives no rows.  Only the named columns are
read; others are kept where ``more`` names them, unless they have the name of a
result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import keep, spool, tune, work_dir

ARITY = 3
#: The tree of the sources' roots.
TOP = -1
#: Leaves that a task reduces, or makes proofs for, at once.
LEAVES = 100_000


def leaf_hash(*values: Column) -> Column:
    """SHA-256, in lowercase hex, of each value as ``-`` if null, else its
    number of UTF-8 bytes, ``:`` and itself."""
    one = lambda v: F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, values)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


class Forest:
    """Unresolved nodes, resolved ones, and the sizes of the trees met."""

    def __init__(self, sizes: dict[int, int]):
        self.sizes, self.open, self.done = sizes, {}, {}

    def width(self, tree: int, level: int) -> int:
        return -(-self.sizes[tree] // ARITY**level)

    def add(self, tree: int, level: int, index: int, node: bytes) -> None:
        while True:
            width = self.width(tree, level)
            if width == 1 and tree != TOP:
                self.done[tree, level, index] = node
                tree, level, index = TOP, 0, tree
                continue
            self.open[tree, level, index] = node
            if width == 1:
                return
            first = index - index % ARITY
            run = [(tree, level, i) for i in range(first, min(first + ARITY, width))]
            if not all(k in self.open for k in run):
                return
            for k in run:
                self.done[k] = self.open.pop(k)
            node = sha256(b"".join([self.done[k] for k in run])).hexdigest().encode()
            level, index = level + 1, index // ARITY

    def merge(self, other: Forest) -> Forest:
        self.sizes.update(other.sizes)
        self.done.update(other.done)
        for (tree, level, index), node in other.open.items():
            self.add(tree, level, index, node)
        return self

    def get(self, key: tuple[int, int, int]) -> bytes | None:
        return self.open.get(key) or self.done.get(key)


class Proofs:
    """Sibling runs from a task's own forest and the merged one."""

    def __init__(self, own: Forest, merged: Forest):
        self.own, self.merged, self.tails = own, merged, {}

    def node(self, *key: int) -> bytes:
        got = self.own.get(key) or self.merged.get(key)
        if got is None:
            raise RuntimeError(f"node {key} is in neither forest")
        return got

    def path(self, tree: int, level: int, index: int) -> list[tuple[bytes, bytes]]:
        """(before, after) of every level from here to the root."""
        width = self.own.width(tree, level)
        if width == 1:
            return [] if tree == TOP else self.tail(TOP, 0, tree)
        first = index - index % ARITY
        before = b"".join([self.node(tree, level, i) for i in range(first, index)])
        after = b"".join([self.node(tree, level, i) for i in range(index + 1, min(first + ARITY, width))])
        return [(before, after), *self.tail(tree, level + 1, index // ARITY)]

    def tail(self, tree: int, level: int, index: int) -> list[tuple[bytes, bytes]]:
        """``path``, remembered for the last node of a level, as leaves come in order."""
        at = self.tails.get((tree == TOP, level))
        if at is None or at[0] != (tree, index):
            at = self.tails[tree == TOP, level] = ((tree, index), self.path(tree, level, index))
        return at[1]

    def subroot(self, tree: int) -> bytes:
        level = 0
        while self.own.width(tree, level) > 1:
            level += 1
        return self.node(tree, level, 0)

    def root(self) -> bytes:
        level = 0
        while self.own.width(TOP, level) > 1:
            level += 1
        return self.node(TOP, level, 0)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Every ``LEAVES`` rows, the same ones in each reading of a partition."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            some = batch.slice(0, LEAVES - n)
            held.append(some)
            n, batch = n + some.num_rows, batch.slice(some.num_rows)
            if n == LEAVES:
                yield held
                held, n = [], 0
    if held:
        yield held


def _reduced(batches: list[pa.RecordBatch], trees: int) -> Forest:
    """The forest of a window's leaves."""
    forest = Forest({TOP: trees})
    for batch in batches:
        for tree, size, index, leaf in zip(*(batch.column(c).to_pylist() for c in ("tree", "size", "index", "leaf"))):
            forest.sizes[tree] = size
            forest.add(tree, 0, index, leaf.encode())
    return forest


def _placed(leaves: DataFrame, root: str) -> DataFrame:
    """``leaves`` with ``tree``, ``size`` and ``index``, in that order within
    the files.

    Rows are dealt by range of source, id, hash and row, so that neither a
    large source nor a repeated row makes a part large.  Counts by part and
    source give the offsets; windows see a row per part, not per leaf.
    """
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // LEAVES))
    order = ("source", "id", "leaf", "row")
    dealt = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = spool(dealt.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), f"{root}/dealt")
    runs = spool(dealt.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("pos").alias("at")), f"{root}/runs")
    trees = runs.groupBy("source").agg(F.min("part").alias("first"), F.sum("n").alias("size"))
    begun = trees.groupBy("first").agg(F.count("*").alias("trees"))
    earlier = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    begun = begun.select("first", F.coalesce(F.sum("trees").over(earlier), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("first").orderBy("source")) - 1
    trees = trees.withColumn("nth", number).join(begun, "first").select("source", "size", (F.col("before") + F.col("nth")).alias("tree"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = runs.join(trees, runs["source"].eqNullSafe(trees["source"])).select(F.col("part").alias("of"), runs["source"].alias("tree_source"), "at", "before", "size", "tree")
    placed = dealt.join(at, (F.col("part") == F.col("of")) & F.col("source").eqNullSafe(F.col("tree_source")))
    placed = placed.withColumn("index", F.col("before") + F.col("pos") - F.col("at")).drop("of", "tree_source", "at", "before", "part", "pos", "row")
    return spool(placed.sortWithinPartitions("tree", "index"), f"{root}/placed")


def prove(rows: DataFrame, leaf_col: str = "leaf", id_col: str = "doc_id", source_col: str = "source", more: Sequence[str] = ()) -> DataFrame:
    """(id, ``more``, leaf, subroot, root, proof): the proof is an array of
    (before, after), the siblings' digests one after the other, from the leaf
    to the root of all."""
    spark = rows.sparkSession
    tune(spark)
    base = work_dir(spark, "merkle")
    keep(base)
    named = {f"__{i}": c for i, c in enumerate(c for c in more if c not in ("subroot", "root", "proof"))}
    leaves = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{leaf_col}`").alias("leaf"), *[F.col(f"`{c}`").alias(k) for k, c in named.items()])
    placed = _placed(spool(leaves.withColumn("row", F.monotonically_increasing_id()), f"{base}/leaves"), base)
    trees = (placed.agg(F.max("tree")).first()[0] if not placed.isEmpty() else -1) + 1

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for window in _windows(batches):
            forest = _reduced(window, trees)
            columns = list(zip(*[(*k, forest.sizes[k[0]], v) for k, v in forest.open.items()]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 4 else pa.int64()) for i, c in enumerate(columns)], names=["tree", "level", "index", "size", "node"])

    schema = "tree long, level long, index long, size long, node binary"
    ends = spool(placed.select("tree", "size", "index", "leaf").mapInArrow(grow, schema), f"{base}/ends")

    def fragment(part: Iterator) -> Iterator[Forest]:
        forest = Forest({TOP: trees})
        for r in part:
            forest.sizes[r["tree"]] = r["size"]
            forest.add(r["tree"], r["level"], r["index"], bytes(r["node"]))
        yield forest

    merged = spark.sparkContext.broadcast(ends.rdd.mapPartitions(fragment).treeReduce(Forest.merge, depth=3) if trees else Forest({TOP: 0}))
    kept = [c for c in placed.columns if c not in ("tree", "size", "index")]

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for window in _windows(batches):
            made = Proofs(_reduced(window, trees), merged.value)
            for batch in window:
                before, after, ends, subroots = [], [], [0], []
                for tree, index in zip(batch.column("tree").to_pylist(), batch.column("index").to_pylist()):
                    for b, a in made.path(tree, 0, index):
                        before.append(b)
                        after.append(a)
                    ends.append(len(before))
                    subroots.append(made.subroot(tree))
                text = lambda x: pa.array(x, pa.binary()).cast(pa.string())
                steps = pa.StructArray.from_arrays([text(before), text(after)], names=["before", "after"])
                more = [text(subroots), text([made.root()] * len(subroots)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], names=[*kept, "subroot", "root", "proof"])

    kinds = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in kept)
    out = placed.mapInArrow(proofs, f"{kinds}, subroot string, root string, proof array<struct<before: string, after: string>>")
    return out.select(F.col("id").alias(id_col), *[F.col(k).alias(c) for k, c in named.items()], "leaf", "subroot", "root", "proof")
