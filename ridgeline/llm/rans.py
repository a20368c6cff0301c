"""Token ids in a binary file format: static range asymmetric numeral system.

``write_ids`` tokenises, counts ids over the whole corpus into one shared
frequency table, and writes shards in ascending document order.  A shard holds
independent blocks of whole documents; a block interleaves ``LANES`` coder
states and stores all states every ``STRIDE`` steps, so that a reader can
decode its sections side by side.  Every block ends in a checksum.

A block is, little-endian: magic ``RLA1``; u32 documents, tokens, lanes,
sections, words; i64 id per document; u32 tokens per document; per section u32
first word and one u64 state per lane; u32 words; u32 CRC-32 of all before.

Files are Parquet of (shard, block, before, n_docs, n_tokens, payload), which
any of Spark's filesystems can hold; ``before`` counts the ids of the shard's
earlier blocks.  The table of frequencies is written beside them.

Defined results: a null or empty text has only the end id; a null document id
sorts first; rows that share an id are ordered by their ids' bytes, equal ones
stay as many; a very long document is whole in one block; an empty table gives
no blocks.  Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import NULL_ID, as_bytes, drop, id_key, slices, spool, tune

MAGIC = b"RLA1"
SCALE = 20
LANES = 512
STRIDE = 256
#: Tokens after which a block closes, at a document's end.
BLOCK = 1 << 18
#: Chunks of text in each of two generations whose ids a worker remembers.
MEMORY = 400_000
#: Punctuation that may close a chunk of letters, and the end of Latin letters.
CLOSING = b".,;:!?"
LATIN = "\u0250"
_HEAD = struct.Struct("<4s5I")
_U = np.uint64
LOW = 1 << 31


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE; every id gets at least one."""
    total, room = int(counts.sum()), (1 << SCALE) - len(counts)
    if room < 0:
        raise ValueError("more ids than the frequency scale holds")
    share = counts.astype(np.float64) * (room / total if total else 0.0)
    out = np.floor(share).astype(np.int64)
    rest = room - int(out.sum())
    if rest and len(counts):
        # ties go to the lower id
        order = np.lexsort((np.arange(len(counts)), -(share - out)))
        out += rest // len(counts)
        out[order[: rest % len(counts)]] += 1
    return (out + 1).astype(np.uint64)


class Coder:
    """Encodes and decodes blocks by one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)])[:-1].astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def encode(self, docs: list[int], sizes: list[int], ids: np.ndarray) -> bytes:
        """One block; ``ids`` has the documents' ids one after the other."""
        n = len(ids)
        steps = -(-n // LANES)
        padded = np.zeros(steps * LANES, np.int64)
        padded[:n] = ids
        rows = padded.reshape(steps, LANES)
        state = np.full(LANES, LOW, np.uint64)
        out: list[np.ndarray] = []
        sections: list[np.ndarray] = []
        counts: list[int] = []
        for s in range(steps - 1, -1, -1):
            f, c = self.freq[rows[s]], self.start[rows[s]]
            over = state >= (f << _U(63 - SCALE))
            word = (state[over] & _U(0xFFFFFFFF)).astype(np.uint32)
            out.append(word)
            counts.append(len(word))
            state = np.where(over, state >> _U(32), state)
            q = state // f
            state = (q << _U(SCALE)) + (state - q * f) + c
            if s % STRIDE == 0:
                sections.append(state.copy())
        words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        ends = np.concatenate([[0], np.cumsum(counts[::-1])]).astype(np.uint32)
        head = _HEAD.pack(MAGIC, len(docs), n, LANES, len(sections), len(words))
        parts = [head, np.array(docs, "<i8").tobytes(), np.array(sizes, "<u4").tobytes()]
        for i, st in enumerate(reversed(sections)):
            parts += [int(ends[i * STRIDE]).to_bytes(4, "little"), st.astype("<u8").tobytes()]
        parts.append(words.astype("<u4").tobytes())
        body = b"".join(parts)
        return body + zlib.crc32(body).to_bytes(4, "little")

    def decode(self, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document ids, tokens of each, all ids) of one block."""
        body, crc = block[:-4], int.from_bytes(block[-4:], "little")
        if zlib.crc32(body) != crc:
            raise ValueError("a block's checksum does not match")
        magic, n_docs, n, lanes, n_sections, n_words = _HEAD.unpack_from(body)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = _HEAD.size
        docs = np.frombuffer(body, "<i8", n_docs, at)
        at += 8 * n_docs
        sizes = np.frombuffer(body, "<u4", n_docs, at)
        at += 4 * n_docs
        cursor, states = np.zeros(n_sections, np.int64), np.zeros((n_sections, lanes), np.uint64)
        for i in range(n_sections):
            cursor[i] = int.from_bytes(body[at : at + 4], "little")
            states[i] = np.frombuffer(body, "<u8", lanes, at + 4)
            at += 4 + 8 * lanes
        words = np.concatenate([np.frombuffer(body, "<u4", n_words, at), np.zeros(1, np.uint32)]).astype(np.uint64)
        steps = -(-n // lanes)
        out = np.zeros((n_sections * STRIDE, lanes), np.uint32)
        mask = _U((1 << SCALE) - 1)
        for k in range(min(STRIDE, steps)):
            # only the last section can be short
            live = n_sections if (n_sections - 1) * STRIDE + k < steps else n_sections - 1
            x = states[:live]
            slot = x & mask
            sym = self.symbol[slot.astype(np.int64)]
            out[k : live * STRIDE : STRIDE] = sym
            x = self.freq[sym] * (x >> _U(SCALE)) + slot - self.start[sym]
            low = x < _U(LOW)
            nth = np.cumsum(low, axis=1)
            where = cursor[:live, None] + nth - 1
            x = np.where(low, (x << _U(32)) | words[np.where(low, where, n_words)], x)
            cursor[:live] += nth[:, -1]
            states[:live] = x
        return docs, sizes, out.reshape(-1)[:n]


def _byte_names() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(256 + i) for i, x in enumerate(rest)}


#: The stages before the model that chunks are right for.
STAGES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class Known(dict):
    """A dictionary that makes and keeps what it lacks."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: bytes) -> bytes:
        value = self[key] = self.make(key)
        return value


class ChunkTokenizer:
    """Ids by chunks between ASCII white space, which no token crosses.

    A chunk of Latin letters, composed, with or without closing punctuation,
    is two pre-tokens at most; these go straight to the library's model.  All
    other chunks go through its whole pipeline.  This holds for the stages in
    ``STAGES`` only; of a tokenizer with others, whole texts go through it.
    """

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        described = json.loads(text)
        self.chunked = all(described.get(k) == v for k, v in STAGES.items())
        self.tokenizer.encode_special_tokens = True  # in a text, their strings are plain text
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.names = _byte_names()
        self.known = Known(self._make)
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.closing: dict[bytes, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        got = self.pieces.get(piece)
        if got is None:
            if len(self.pieces) >= MEMORY:
                self.pieces.clear()
            name = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.names)
            got = array(self.code, [t.id for t in self.model.tokenize(name)]).tobytes()
            self.pieces[piece] = got
        return got

    def _simple(self, chunk: bytes) -> bytes | None:
        """Ids of a chunk of letters and closing punctuation, else None."""
        core = chunk.rstrip(CLOSING)
        word = core.decode("utf-8")
        if not word.isalpha():
            return None
        if word.isascii():
            word = word.lower()
        elif max(word) < LATIN and is_normalized("NFC", word):
            word = word.lower()  # no letter here has a lower case that depends on its place
            if not word.isalpha():
                return None
        else:
            return None
        ids = self._piece(word)
        if len(core) == len(chunk):
            return ids
        after = chunk[len(core) :]
        closing = self.closing.get(after)
        if closing is None:
            closing = self._piece(after.decode("utf-8"))
            if len(self.closing) < MEMORY:
                self.closing[after] = closing
        return ids + closing

    def _make(self, chunk: bytes) -> bytes:
        """Ids of a chunk that this generation lacks."""
        ids = self.older.get(chunk)
        if ids is None:
            ids = self._simple(chunk)
        if ids is None:
            got = self.tokenizer.encode_batch_fast([chunk.decode("utf-8")], add_special_tokens=False)
            ids = array(self.code, got[0].ids).tobytes()
        return ids

    def encode(self, texts: list[bytes | None], end_id: int) -> list[bytes]:
        if not self.chunked:
            got = self.tokenizer.encode_batch_fast([(t or b"").decode("utf-8") for t in texts], add_special_tokens=False)
            return [array(self.code, [*g.ids, end_id]).tobytes() for g in got]
        if len(self.known) > MEMORY:
            self.known, self.older = Known(self._make), self.known
        end, get = array(self.code, [end_id]).tobytes(), self.known.__getitem__
        return [b"".join(map(get, (t or b"").split())) + end for t in texts]


_tokenizers: dict[int, ChunkTokenizer] = {}


def _tokenizer(text: str) -> ChunkTokenizer:
    key = zlib.crc32(text.encode())
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = ChunkTokenizer(text)
    return _tokenizers[key]


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, ids): ids as little-endian integers, with the end id last."""
    spark = docs.sparkSession
    tune(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(source.value)
        for batch in slices(batches, "text", 4 << 20):
            ids = tokenizer.encode(as_bytes(batch.column(1)), end_id)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc", "ids"])

    return docs.select(id_key(id_col).alias("doc"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc long, ids binary")


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents under ``path``."""
    spark = docs.sparkSession
    tokens = spool(tokenise(docs, tokenizer_path, end_id, id_col, text_col), f"{path}/tokens", codec="zstd")
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = ChunkTokenizer(f.read())
    kind, size = tokenizer.kind, max(tokenizer.size, end_id + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    freq = frequencies(counts)
    spark.createDataFrame([(freq.astype("<u4").tobytes(),)], "freq binary").write.parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast(freq)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = Coder(shared.value), TaskContext.get().partitionId()
        ids, docs_, sizes, total, before, block = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            payload = coder.encode(docs_, sizes, np.frombuffer(b"".join(ids), kind))
            arrays = [[shard], [block], [before], [len(docs_)], [total]]
            return pa.RecordBatch.from_arrays([*(pa.array(a, pa.int64()) for a in arrays), pa.array([payload], pa.binary())], names=["shard", "block", "before", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for doc, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(some) // np.dtype(kind).itemsize
                docs_.append(doc)
                sizes.append(n)
                ids.append(some)
                total += n
                if total >= BLOCK:
                    yield close()
                    before, block = before + total, block + 1
                    ids, docs_, sizes, total = [], [], [], 0
        if docs_:
            yield close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(parts, "doc").sortWithinPartitions("doc", "ids")
    ordered.mapInArrow(pack, "shard long, block long, before long, n_docs long, n_tokens long, payload binary").write.parquet(f"{path}/blocks")
    drop(spark, f"{path}/tokens")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, in any order."""
    tune(spark)
    freq = np.frombuffer(spark.read.parquet(f"{path}/frequencies").first()[0], "<u4")
    shared = spark.sparkContext.broadcast(freq.astype(np.uint64))
    blocks = spark.read.parquet(f"{path}/blocks")
    # one total per file, in shard order
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    starts, at = {}, 0
    for r in totals:
        starts[r["shard"]] = at
        at += r["n"]
    first = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for shard, before, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                docs, sizes, ids = coder.decode(payload)
                ends = np.cumsum(sizes.astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                start = first.value[shard] + before + ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(start), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    out = blocks.select("shard", "before", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))
