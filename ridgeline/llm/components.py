"""Connected components of a link table, distributed and iterative."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import drop, spool

#: Links (16 bytes each) that one task may join; more go through the rounds.
SMALL = 1_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all links of one task; the root is the smallest node."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    for i in range(0, len(nodes), 1 << 16):
        some = nodes[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], names=["node", "label"])


def components(spark: SparkSession, links: DataFrame, path: str, most_rounds: int = 200) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); the label is the
    smallest node reachable.

    Each round takes the least label among neighbours and then follows the
    label of the label, so that long chains shorten by doubling.  Labels are
    written to the shared folder each round, which cuts the lineage.  Counted
    links of up to ``SMALL`` are joined in one task instead.
    """
    links = spool(links.select("a", "b").where("a <> b"), f"{path}/links")
    if links.count() <= SMALL:
        return spool(links.coalesce(1).mapInArrow(_joined, "node long, label long"), f"{path}/labels")
    both = spool(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), f"{path}/edges")
    labels = spool(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), f"{path}/labels0")
    for i in range(1, most_rounds + 1):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("next"), F.col("label").alias("was"))
        hop = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        new = step.join(hop, F.col("next") == F.col("at"), "left").select("node", F.least("next", "far").alias("label"), "was")
        new = spool(new, f"{path}/labels{i}")
        done = new.where("label <> was").isEmpty()
        drop(spark, f"{path}/labels{i - 1}")
        labels = new.select("node", "label")
        if done:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
