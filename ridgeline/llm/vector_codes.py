"""Product codes of vectors, with codebooks trained on every row.

Components become integers and vectors are cut into equal parts; each part has
a codebook of its own.  Rows are held as blocks of columns, one binary per
block, dimension after dimension.  A round is one ``treeAggregate``: each block
accumulates squared distances dimension by dimension, ``np.add.at`` adds its
parts to sums and counts by entry, and these tensors, whose size is that of the
codebooks, merge through a reduction tree.  All arithmetic is on integers, so
that the order of merging cannot change a result.

Defined results: a row whose vector is null or has null or non-finite
components is dropped; shorter vectors count as followed by zeros up to the
longest one and to a multiple of the parts, empty ones too; a null id comes after
all others; rows that share an id are rows of their own, in the order of their
components when the first ones are picked; with fewer rows than entries there
are as many entries as rows; an empty table gives no rows.  Components beyond
2**26 are computed with whole numbers of any length; an error that a long
cannot hold is null.  Only id, vector and label are read, so other columns
cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import keep, spool, tune, work_dir

#: Rows of a block.
ROWS = 2048
#: Rows of which distances to all entries are held at once.
STEP = 256
#: Largest component for which distances and sums fit 64 bits.
SMALL = 1 << 26
#: Labels with at least this part of all rows meet their sums by broadcast.
HOT_PART = 256


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) as int64, or as Python's integers if one is large."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    if not scaled.size or np.abs(scaled).max() <= SMALL:
        return scaled.astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 2**52 else int(v) * scale for v in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def nearest(columns: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest of ``entries`` (entry,
    dimension) for ``columns`` (dimension, row); ties go to the lower index."""
    if columns.dtype != object and entries.dtype != object:
        most = int(max(np.abs(columns).max(initial=0), np.abs(entries).max(initial=0)))
        kind = np.int32 if 4 * most * most * max(1, len(columns)) < 2**31 else np.int64
        columns, entries = columns.astype(kind), entries.astype(kind)
    index, error = np.empty(columns.shape[1], np.int64), np.empty(columns.shape[1], entries.dtype if columns.dtype != object else object)
    flipped = np.ascontiguousarray(entries.T)
    for at in range(0, columns.shape[1], STEP):
        some = columns[:, at : at + STEP]
        total = np.zeros((some.shape[1], len(entries)), np.result_type(some, flipped))
        for x, c in zip(some, flipped):
            d = x[:, None] - c[None, :]
            d *= d
            total += d
        best = total.argmin(axis=1)
        index[at : at + STEP] = best
        error[at : at + STEP] = total[np.arange(len(best)), best]
    return index, error


class Books:
    """One codebook per part; ``parts`` arrays of (entry, dimension)."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts

    def split(self, columns: np.ndarray) -> list[np.ndarray]:
        return np.split(columns, len(self.parts))

    def totals(self, columns: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Sums and counts of a block's parts by their nearest entry."""
        sums, counts = [], []
        for part, entries in zip(self.split(columns), self.parts):
            index, _ = nearest(part, entries)
            total, n = np.zeros(entries.shape, part.dtype), np.zeros(len(entries), np.int64)
            np.add.at(total, index, part.T)
            np.add.at(n, index, 1)
            sums.append(total)
            counts.append(n)
        return sums, counts

    def moved(self, totals: tuple[list[np.ndarray], list[np.ndarray]]) -> Books:
        """Entries at the floor of their mean; unused ones stay."""
        out = []
        for entries, total, n in zip(self.parts, *totals):
            mean = total // np.maximum(n, 1).astype(total.dtype)[:, None]
            out.append(_narrow(np.where((n > 0)[:, None], mean, entries)))
        return Books(out)

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place."""
        return hashlib.sha256(",".join(str(v) for p in self.parts for v in p.ravel().tolist()).encode()).hexdigest()


def _narrow(entries: np.ndarray) -> np.ndarray:
    return entries.astype(np.int64) if entries.dtype == object and all(abs(v) <= SMALL for v in entries.ravel()) else entries


def _wide(total: np.ndarray, rows: int) -> np.ndarray:
    """``total`` as Python's integers if more rows could exceed 64 bits."""
    return total if total.dtype == object or rows < 2**36 else total.astype(object)


def _merged(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return b if a is None else a
    counts = [x + y for x, y in zip(a[1], b[1])]
    return [_wide(x, int(n.sum())) + y for x, y, n in zip(a[0], b[0], counts)], counts


def _blocks(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """Rows (ids, labels, n, values): blocks of columns of floats of a kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            vectors = t.column("vector").combine_chunks()
            sizes = np.diff(vectors.offsets.to_numpy())
            out = np.zeros((t.num_rows, width), kind)
            out[np.arange(width)[None, :] < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks())
            return pa.RecordBatch.from_arrays([one("id"), one("label"), pa.array([t.num_rows]), pa.array([np.ascontiguousarray(out.T).tobytes()], pa.binary())], names=["ids", "labels", "n", "values"])

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                yield close()
                held, n = [], 0
        if n:
            yield close()

    ids, labels = (T.ArrayType(rows.schema[c].dataType) for c in ("id", "label"))
    schema = T.StructType().add("ids", ids).add("labels", labels).add("n", T.LongType()).add("values", T.BinaryType())
    return rows.mapInArrow(run, schema)


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Any]:
    """(id, label, code, error, label_error) of every kept row, and the books."""
    spark = vectors.sparkSession
    tune(spark)
    root = work_dir(spark, "codes")
    keep(root)
    v = F.col("vector")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
    kind = "<f4" if rows.schema["vector"].dataType.elementType == T.FloatType() else "<f8"
    if kind == "<f8":
        rows = rows.withColumn("vector", v.cast("array<double>"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(v.isNotNull() & finite)
    longest = rows.agg(F.max(F.size(v))).first()[0]
    width = max(1, -(-(longest or 0) // parts)) * parts
    blocks = spool(_blocks(rows, width, kind), f"{root}/blocks", codec="zstd")
    first = rows.orderBy(F.col("id").asc_nulls_last(), v).limit(entries).collect()  # ``entries`` rows
    start = np.zeros((len(first), width))
    for i, r in enumerate(first):
        start[i, : len(r["vector"])] = r["vector"]
    books = Books(np.split(whole(start, scale), parts, axis=1))
    held = blocks.select("n", "values").rdd
    read = lambda n, raw: whole(np.frombuffer(raw, kind).reshape(width, n).astype(np.float64), scale)
    for _ in range(rounds if first else 0):
        now = spark.sparkContext.broadcast(books)
        totals = held.treeAggregate(None, lambda acc, r, now=now: _merged(acc, now.value.totals(read(r["n"], r["values"]))), _merged)
        books = books.moved(totals)
        now.unpersist()
    last = spark.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = read(batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                found = [nearest(p, e) for p, e in zip(last.value.split(columns), last.value.parts)]
                codes = np.stack([index for index, _ in found], axis=1).astype(">u1" if entries <= 256 else ">u4")
                total = sum(error.astype(object) for _, error in found)
                error = [int(e) if e < 2**63 else None for e in total]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    schema = T.StructType().add("id", rows.schema["id"].dataType).add("label", rows.schema["label"].dataType).add("code", T.StringType()).add("error", T.LongType())
    coded = spool(blocks.mapInArrow(code, schema), f"{root}/coded")
    return _with_label_error(coded, f"{root}/labels").select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), books


def _with_label_error(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` with the error summed over rows of its label.  Labels with a
    ``HOT_PART``-th of all rows, that many at most, meet their sums by
    broadcast; all others by a shuffle in which none of them is large."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = (F.count("error") == F.count("*")) & (total < F.lit(2**63 - 1).cast("decimal(38,0)"))
    sums = spool(coded.groupBy(F.col("label").alias("of")).agg(F.count("*").alias("n"), F.when(fits, total.cast("long")).alias("label_error")), path)
    rows = sums.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(sums.where(F.col("n") * HOT_PART >= rows).select("of", "label_error", F.lit(True).alias("hot")))
    met = coded.join(hot, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    cold = sums.where(F.col("n") * HOT_PART < rows).select("of", F.col("label_error").alias("cold_error"))
    rest = met.where("hot IS NULL").join(cold, F.col("label").eqNullSafe(F.col("of"))).select("id", "label", "code", "error", F.col("cold_error").alias("label_error"))
    return met.where("hot").select("id", "label", "code", "error", "label_error").union(rest)
