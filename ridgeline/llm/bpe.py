"""Byte-level BPE encoding and decoding.

A pre-token's bytes form a linked list.  Each adjacent pair that has a merge
rank lies in the bucket of its rank; a hierarchical bitmap over ranks, two
levels of 256-bit words, finds the lowest non-empty bucket with find-first-set,
so that a merge costs a few steps however long the pre-token is.  Entries of a
bucket that no longer describe a pair are skipped when they come up.

Defined results: a null or empty text has no ids; ids decode to the bytes of
the text; special tokens are never produced; of pairs with one rank the first
in the text is merged first; a very long text is one list in a worker; rows are
coded by text alone, so repeated rows get equal ids; an empty table gives an
empty table; columns with the names of the new ones are replaced, all others
stay.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ridgeline.llm.common import extended, slices, tune, with_columns

#: Ranks in one word of the bitmap, as a power of two.
SHIFT = 8
MASK = (1 << SHIFT) - 1
#: Pre-tokens in each of two generations whose ids a worker remembers.
MEMORY = 400_000
STEP_BYTES = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class BytePairs:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = [ranks.get(bytes([i])) for i in range(256)]
        # the lower level of the bitmap; every merge leaves it empty
        self.words = [0] * ((max(ranks.values(), default=0) >> SHIFT) + 1)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        ``buckets`` has positions by rank, leftmost first; ``top`` has a bit
        per word of ranks in use, ``words`` a bit per rank.
        """
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n, words, top = len(piece), self.words, 0
        buckets: dict[int, list[int]] = {}
        ids, pair = [self.single[x] for x in piece], [-1] * (n + 1)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [i]
                    words[rank >> SHIFT] |= 1 << (rank & MASK)
                    top |= 1 << (rank >> SHIFT)
                else:
                    bucket.append(i)
        while top:
            at = (top & -top).bit_length() - 1
            first = words[at] & -words[at]
            rank = at << SHIFT | first.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[at] ^= first
                if not words[at]:
                    top ^= 1 << at
            if pair[i] != rank:
                continue  # merged away or paired anew since it was queued
            j = after[i]
            end = after[i] = after[j]
            ids[i], pair[i], pair[j] = rank, -1, -1
            h = before[i]
            if end < n:
                before[end] = i
                changed = ((i, piece[i : after[end]]), (h, piece[h:end])) if h >= 0 else ((i, piece[i : after[end]]),)
            elif h >= 0:
                changed = ((h, piece[h:end]),)
            else:
                continue
            for i, joined in changed:
                rank = get(joined)
                if rank is None:
                    pair[i] = -1
                    continue
                pair[i] = rank
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [i]
                    words[rank >> SHIFT] |= 1 << (rank & MASK)
                    top |= 1 << (rank >> SHIFT)
                else:
                    heappush(bucket, i)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _ids(self, piece: str) -> bytes:
        """Ids of a pre-token that ``known`` lacks; of pre-tokens seen since
        the memory was last full, none is forgotten."""
        ids = self.older.get(piece)
        if ids is None:
            ids = b"".join([i.to_bytes(4, "little") for i in self.merge(piece.encode("utf-8"))])
        if len(piece) <= 64:
            if len(self.known) >= MEMORY:
                self.known, self.older = {}, self.known
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        got, parts = self.known.get, []
        for piece in self.pattern.findall(text):
            ids = got(piece)
            if ids is None:
                ids = self._ids(piece)
                got = self.known.get
            parts.append(ids)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_coders: dict[tuple[int, str], BytePairs] = {}


def _coder(ranks, pattern: str) -> BytePairs:
    """One coder per worker and broadcast table."""
    table = ranks.value
    key = (hash(frozenset(table.items())), pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = BytePairs(table, pattern)
    return _coders[key]


def _share(df: DataFrame, path: str):
    """The rank table (a fixed file, about a megabyte) for all executors."""
    return df.sparkSession.sparkContext.broadcast(read_ranks(path))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: ids as little-endian unsigned 32-bit integers."""
    tune(docs.sparkSession)
    ranks = _share(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch in slices(batches, text_col, STEP_BYTES):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield with_columns(batch, {ids_col: pa.array([coder.encode(t) if t else b"" for t in texts], pa.binary())})

    return docs.mapInArrow(run, extended(docs.schema, (ids_col, T.BinaryType())))


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``bytes_col``: the bytes that the ids stand for."""
    tune(encoded.sparkSession)
    ranks = _share(encoded, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            yield with_columns(batch, {bytes_col: pa.array([coder.decode(i) if i else b"" for i in ids], pa.binary())})

    return encoded.mapInArrow(run, extended(encoded.schema, (bytes_col, T.BinaryType())))
