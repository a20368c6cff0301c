"""Fixed-length training sequences by cost-balanced packing.

A document's ids are cut into pieces of the sequence length and a rest.  Full
pieces are sequences of their own.  Rests are dealt to blocks of about
``BLOCK`` sequences by a hash of their row, so that no document, source or group
of copies makes a block large; each block is packed by itself.  A block opens as
many sequences as its ids fill, and for what is left over one for each power of
two in that number, so that nothing is padded.  Its rests go, longest first, to
the sequence of least cost that still has room for them; cost is linear in the
tokens plus quadratic in each piece, as attention does not cross documents.  A
rest that no sequence has room for fills the roomiest one and goes on with what
remains, so that at most one cut is made for each sequence filled.

Defined results: a null or empty text is its end id alone; a null document id
stays null; rows that share an id are documents of their own; equal lengths
go by id, then by row; an empty table gives no pieces.  Only id and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import NULL_ID, as_bytes, id_key, keep, slices, spool, tune, work_dir
from ridgeline.llm.rans import _tokenizer

#: Sequences of one block; its ids (4 bytes each) are held by one task.
BLOCK = 128
#: Cost of a token against that of a pair of tokens in one piece: six times the
#: width of a model of 4,096.
LINEAR = 6 * 4096
_PIECES = "doc long, start long, length long, ids binary, doc_tokens long"
_PACKED = "doc long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def capacities(total: int, size: int) -> np.ndarray:
    """Lengths of the sequences that ``total`` ids fill without padding."""
    left = total % size
    return np.array([size] * (total // size) + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1], np.int64)


def assign(lengths: np.ndarray, rooms: np.ndarray, linear: int = LINEAR) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset) of ``lengths``, which
    descend, packed into sequences with ``rooms``, which hold them all."""
    room, cost, out = rooms.copy(), np.zeros(len(rooms)), []
    for i, left in enumerate(lengths.tolist()):
        start = 0
        while left:
            fits = np.flatnonzero(room >= left)
            s = int(fits[cost[fits].argmin()]) if len(fits) else int(np.lexsort((cost, -room))[0])
            n = min(left, int(room[s]))
            out.append((i, start, n, s, int(rooms[s] - room[s])))
            room[s] -= n
            cost[s] += linear * n + n * n
            start, left = start + n, left - n
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): every
    piece of every document with its ids as little-endian u32.

    Sequence ids are unique and not dense: odd ones are full pieces, even ones
    hold the block above bit 32.
    """
    spark = docs.sparkSession
    tune(spark)
    root = work_dir(spark, "packing")
    keep(root)
    with open(tokenizer_path, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(source.value)
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), tokenizer.encode(as_bytes(batch.column(1)), end_id)):
                ids = np.frombuffer(raw, tokenizer.kind).astype("<u4").tobytes()
                n = len(ids) // 4
                rows += [(doc, i, min(size, n - i), ids[4 * i : 4 * (i + size)], n) for i in range(0, n, size)]
            yield _batch(rows, ("doc", "start", "length", "ids", "doc_tokens"))

    pieces = docs.select(id_key(id_col).alias("doc"), F.col(f"`{text_col}`").alias("text")).mapInArrow(cut, _PIECES)
    pieces = spool(pieces.withColumn("row", F.monotonically_increasing_id()), f"{root}/pieces", codec="zstd")
    rests = pieces.where(F.col("length") < size)
    blocks = max(1, round((rests.agg(F.sum("length")).first()[0] or 0) / (size * BLOCK)))

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc", "ascending"), ("row", "ascending")])
        lengths = group.column("length").to_numpy()
        rooms = capacities(int(lengths.sum()), size)
        doc, first, ids, tokens = (group.column(c).to_pylist() for c in ("doc", "start", "ids", "doc_tokens"))
        block = group.column("block")[0].as_py()
        rows = [(doc[i], first[i] + a, n, ids[i][4 * a : 4 * (a + n)], tokens[i], (block << 32 | s) * 2, at) for i, a, n, s, at in assign(lengths, rooms)]
        return pa.Table.from_batches([_batch(rows, ("doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"))])

    packed = rests.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).groupBy("block").applyInArrow(fill, _PACKED)
    full = pieces.where(F.col("length") == size).select("doc", "start", "length", "ids", "doc_tokens", (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.union(packed).withColumn("doc", F.nullif("doc", F.lit(NULL_ID))).withColumnRenamed("doc", "doc_id")


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns)], names=list(names))
