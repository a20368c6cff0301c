"""Line dedup over a levelled store of sorted runs of line hashes.

Documents are taken in batches of descending id.  A batch is reduced to one
entry per line key - (128-bit hash, number of documents, largest document) -
and merge-anti-joined against the runs already stored: a key that has reached
the repeat threshold in an earlier batch is settled, since its owner (the
largest document) lies in that earlier batch, and is not stored again.  What is
left becomes a new sorted run of level 0.  When a level holds ``fanout`` runs
they are merged into one run of the next level.

Defined results: a null or empty text is one empty line; lines are split at
``\\n`` only; a null id counts as one document before all others; rows that
repeat an id count as one document; an empty table gives an empty table.
"""

from __future__ import annotations

import secrets
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import CODEC, as_bytes, drop, extended, id_key, result, spool, tune, with_columns, work_dir

SPACE = b" \t\n\x0b\x0c\r"
_MAX_UTF8 = 4
#: Lines that are broadcast at most (32 bytes each).
HOT = 50_000
#: Entries (32 bytes each) of the whole feed for each bucket of a run.
PER_BUCKET = 1_000_000
_ORDERED, _PARTS = "spark.sql.legacy.bucketedTableScan.outputOrdering", "spark.sql.shuffle.partitions"


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    """Whether a key has ``min_chars`` code points."""
    if len(key) < min_chars:
        return False
    return len(key) >= _MAX_UTF8 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars


def _hasher(min_chars: int, seed: int):
    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, parts, digests = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            owner, part = [], []
            for doc, text, p in zip(docs, as_bytes(batch.column(1)), parts):
                found = {xxhash.xxh3_128_digest(k, seed) for k in map(line_key, (text or b"").split(b"\n")) if long_enough(k, min_chars)}
                digests.extend(found)
                owner.extend([doc] * len(found))
                part.extend([p] * len(found))
            if digests:
                h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(owner, pa.int64()), pa.array(part, pa.int32())],
                    names=["h1", "h2", "doc", "part"],
                )

    return hash_lines


FEED = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("part", T.IntegerType())])


class LineStore:
    """Sorted runs of (h1, h2, n, owner), in levels, under one shared folder."""

    def __init__(self, spark: SparkSession, path: str, entries: int, min_docs: int = 3, fanout: int = 2):
        """For about ``entries`` in all; until ``close`` the session shuffles
        into as many parts as a run has buckets, never more than before."""
        self.spark, self.path, self.min_docs, self.fanout = spark, path, min_docs, fanout
        self.levels: list[list[str]] = []
        self.name, self._made = f"ridgeline_lines_{uuid.uuid4().hex}", 0
        self._was = {k: spark.conf.get(k) for k in (_ORDERED, _PARTS)}
        spark.conf.set(_ORDERED, "true")  # each bucket is one sorted file
        spark.conf.set(_PARTS, str(max(1, min(int(self._was[_PARTS]), -(-entries // PER_BUCKET)))))
        self.buckets = int(spark.conf.get(_PARTS))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def ingest(self, entries: DataFrame) -> None:
        """Add a batch: ``entries`` has one row (h1, h2, n, owner) per key."""
        for run in self.runs():
            settled = run.where(F.col("n") >= self.min_docs).select("h1", "h2")
            entries = entries.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        self._add(0, entries)

    def merged(self) -> DataFrame:
        """One entry per key over all runs."""
        return self._merge(self.runs())

    def close(self) -> None:
        for level in self.levels:
            for t in level:
                self._drop(t)
        self.levels = []
        for k, v in self._was.items():
            self.spark.conf.set(k, v)

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select("h1", "h2", F.col("n").alias("more"), F.col("owner").alias("other"))
            n = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
            owner = F.greatest("owner", "other")
            return a.join(b.hint("merge"), ["h1", "h2"], "full").select("h1", "h2", n.alias("n"), owner.alias("owner"))

        return reduce(two, runs)

    def _add(self, level: int, entries: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        run, self._made = f"{self.name}_{self._made}", self._made + 1
        writer = entries.select("h1", "h2", "n", "owner").write.format("parquet").option("path", f"{self.path}/{run}").option("compression", CODEC)
        writer.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(run)
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._add(level + 1, self._merge([self.spark.table(t) for t in old]))
            for t in old:
                self._drop(t)

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        drop(self.spark, f"{self.path}/{run}")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 3,
    min_chars: int = 20,
    batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """Drop lines found in at least ``min_docs`` documents but for their last.

    Returns the columns of ``docs`` with ``text_col`` rewritten, and
    ``n_lines`` (before) and ``n_dropped``; columns of ``docs`` with these two
    names are replaced.
    """
    spark = docs.sparkSession
    tune(spark)
    root, seed = work_dir(spark, "lines"), secrets.randbits(63)  # nobody can write lines of one hash
    key = id_key(id_col)
    cuts = sorted(set(docs.select(key.alias("k")).approxQuantile("k", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    part = F.lit(len(cuts)).cast("int")
    for cut in cuts:
        part = part - (F.col("doc") > F.lit(cut)).cast("int")
    feed = docs.select(key.alias("doc"), F.col(f"`{text_col}`").alias("text")).select("doc", "text", part.alias("part"))
    feed = spool(feed.mapInArrow(_hasher(min_chars, seed), FEED), f"{root}/feed")
    total = feed.count()

    store = LineStore(spark, f"{root}/store", total, min_docs, fanout)
    try:
        for k in range(len(cuts) + 1):
            batch = feed.where(F.col("part") == k)
            # a row lists a key once, but several rows may share an id
            one = batch.select("h1", "h2", "doc").distinct().groupBy("h1", "h2").agg(F.max("doc").alias("owner"), F.count("*").alias("n"))
            store.ingest(one.select("h1", "h2", "n", "owner"))
        repeated = spool(store.merged().where(F.col("n") >= min_docs).select("h1", "h2", "n", "owner"), f"{root}/repeated")
    finally:
        store.close()
    lines, hot = feed.select("h1", "h2", "doc"), F.col("n") > -(-total // HOT)
    often = F.broadcast(repeated.where(hot).drop("n"))
    seldom = lines.join(often, ["h1", "h2"], "left_anti").join(repeated.where(~hot).drop("n"), ["h1", "h2"])
    cut = lines.join(often, ["h1", "h2"]).union(seldom).where(F.col("doc") != F.col("owner"))
    cut = cut.groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("__rl_cut")).withColumnRenamed("doc", "__rl_key")
    cut = result(cut, root)
    out = docs.withColumn("__rl_key", key).join(cut, "__rl_key", "left").drop("__rl_key")
    own = docs.drop("n_lines", "n_dropped")
    schema = extended(own.schema, ("n_lines", T.LongType()), ("n_dropped", T.LongType()))
    return out.select(*[f"`{c}`" for c in own.columns], "__rl_cut").mapInArrow(_remover(text_col, min_chars, seed), schema)


def _remover(text_col: str, min_chars: int, seed: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts, n_lines, n_dropped = [], [], []
            cuts = batch.column(batch.schema.get_field_index("__rl_cut")).to_pylist()
            for text, cut in zip(as_bytes(batch.column(at)), cuts):
                lines = (text or b"").split(b"\n")
                kept = lines
                if cut:
                    gone = {np.array([c["h1"], c["h2"]], dtype="<i8").tobytes() for c in cut}
                    kept = [x for x in lines if not (long_enough(k := line_key(x), min_chars) and xxhash.xxh3_128_digest(k, seed) in gone)]
                    text = b"\n".join(kept)
                texts.append(text)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            new = {
                text_col: pa.array(texts, pa.binary()).cast(pa.string()).cast(batch.schema.field(at).type),
                "n_lines": pa.array(n_lines, pa.int64()),
                "n_dropped": pa.array(n_dropped, pa.int64()),
            }
            yield with_columns(batch, new, ["__rl_cut"])

    return remove
