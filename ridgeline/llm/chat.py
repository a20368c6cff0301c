"""Chat formatting by columnar byte assembly.

Turns become segments of one text per conversation:

    user       ``<s>[INST] `` text `` [/INST]``
    assistant  `` `` text `` </s>``
    system     ``<<SYS>>`` text ``<</SYS>>``
    other      ``<<ROLE:`` role ``:>>`` text ``<</ROLE>>``

Inside texts a backslash is doubled and a control string gets a backslash after
its first character, so that no control string survives and the text can be
had back.  For a batch, lengths of headers, texts and trailers give offsets and
scatter indices, and one preallocated buffer takes all bytes.

The output has one row per fragment: consecutive turns of one conversation in
one task, in order (shard, seq).  A range shuffle on conversation and turn
deals a very long conversation to several tasks.

Defined results: null texts and roles are empty; null ids and turns sort
first; turns with equal numbers are ordered by role, then text, and repeated
rows are turns of their own; a very long text is copied as a whole, not byte by
byte; an empty table gives no rows.  Only the four named columns are read, so
others cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import as_bytes, slices, tune

#: The control strings; fixed values of the format.
CONTROL = (b"<s>", b"</s>", b"[INST]", b"[/INST]", b"<<SYS>>", b"<</SYS>>", b"<<ROLE:", b"<</ROLE>>", b":>>")
_ANY = re.compile(b"|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_HINT = re.compile(rb"[\\<>\[]")
WRAP = {b"user": (b"<s>[INST] ", b" [/INST]"), b"assistant": (b" ", b" </s>"), b"system": (b"<<SYS>>", b"<</SYS>>")}


def escape(text: bytes) -> bytes:
    if not _HINT.search(text):
        return text
    text = text.replace(b"\\", b"\\\\")
    while True:
        new = _ANY.sub(lambda m: m[0][:1] + b"\\" + m[0][1:], text)
        if new == text:
            return text
        text = new


def unescape(text: bytes) -> bytes:
    return re.sub(rb"\\(.)", rb"\1", text, flags=re.S) if b"\\" in text else text


def wrap(role: bytes) -> tuple[bytes, bytes]:
    """Header and trailer of a turn."""
    return WRAP.get(role) or (b"<<ROLE:" + escape(role) + b":>>", b"<</ROLE>>")


#: Bytes from which a cell is copied as a block instead of scattered.
LONG = 1 << 14


def assemble(parts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Interleave columns of byte strings: row after row, column after column.

    Returns the bytes, and offsets of all cells with one entry more.
    """
    n, k = len(parts[0]), len(parts)
    lens = np.empty((n, k), np.int64)
    for j, column in enumerate(parts):
        lens[:, j] = np.fromiter(map(len, column), np.int64, n)
    at = np.concatenate([[0], np.cumsum(lens.reshape(-1))])
    out = np.empty(int(at[-1]), np.uint8)
    if len(out) >= 1 << 31:
        raise ValueError("a batch of more than two gigabytes")
    for j, column in enumerate(parts):
        short, begins = lens[:, j] < LONG, at[j:-1:k]
        data = np.frombuffer(b"".join([c for c, s in zip(column, short.tolist()) if s]), np.uint8)
        sizes = lens[short, j]
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        out[np.arange(len(data)) + np.repeat(begins[short] - begin, sizes)] = data
        for i in np.flatnonzero(~short).tolist():
            out[begins[i] : begins[i] + lens[i, j]] = np.frombuffer(column[i], np.uint8)
    return out, at


def format_chats(turns: DataFrame) -> DataFrame:
    """Fragments (conv_id, shard, seq, text, loss): ``loss`` lists the byte
    ranges of assistant texts (begin, end pairs) in the fragment's text."""
    spark = turns.sparkSession
    tune(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = rows.repartitionByRange(parts, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", 2 << 20):
            conv, roles = batch.column(0).to_pylist(), as_bytes(batch.column(2))
            wraps = {r: wrap(r) for r in set(roles)}
            texts = [escape(t) for t in as_bytes(batch.column(3))]
            data, at = assemble([[wraps[r][0] for r in roles], texts, [wraps[r][1] for r in roles]])
            heads = [i for i in range(len(conv)) if i == 0 or conv[i] != conv[i - 1]] + [len(conv)]
            bounds = at[3 * np.array(heads)]
            fragments = pa.StringArray.from_buffers(len(heads) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))
            loss = [
                [int(x - at[3 * a]) for i in range(a, b) if roles[i] == b"assistant" for x in (at[3 * i + 1], at[3 * i + 2])]
                for a, b in zip(heads, heads[1:])
            ]
            n = len(heads) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv[h] for h in heads[:-1]], pa.int64()), pa.array([shard] * n, pa.int64()), pa.array(range(seq, seq + n), pa.int64()), fragments, pa.array(loss, pa.list_(pa.int64()))],
                names=["conv_id", "shard", "seq", "text", "loss"],
            )
            seq += n

    return rows.mapInArrow(run, "conv_id long, shard long, seq long, text string, loss array<long>")


def parse(text: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of each turn of a fragment."""
    at = 0
    while at < len(text):
        for role, (head, tail) in ((r, w) for r, w in WRAP.items() if r != b"assistant"):
            if text.startswith(head, at):
                break
        else:
            if text.startswith(b"<<ROLE:", at):
                end = text.index(b":>>", at)
                role, head, tail = unescape(text[at + 7 : end]), text[at : end + 3], b"<</ROLE>>"
            else:
                role, (head, tail) = b"assistant", WRAP[b"assistant"]
        begin = at + len(head)
        end = text.index(tail, begin)
        yield role, unescape(text[begin:end])
        at = end + len(tail)


def read_chats(fragments: DataFrame) -> DataFrame:
    """Counts and digests per conversation, read back from the fragments.

    A conversation is hashed fragment after fragment; only one is held.
    """
    rows = fragments.select("conv_id", "shard", "seq", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "shard", "seq")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun = None, False
        n = chars = loss_chars = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[] for _ in names]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            done.clear()
            return out

        for batch in batches:
            for conv, text, spans in zip(batch.column(0).to_pylist(), as_bytes(batch.column(3)), batch.column(4).to_pylist()):
                if not begun or conv != now:
                    if begun:
                        done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    now, begun = conv, True
                    n = chars = loss_chars = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, said in parse(text):
                    n += 1
                    turns.update(role + b"\n" + said + b"\n")
                for a, b in zip(spans[::2], spans[1::2]):
                    said = unescape(text[a:b])
                    loss.update(said)
                    loss_chars += len(said.decode("utf-8"))
                chars += len(text.decode("utf-8"))
            if done:
                yield flush()
        if begun:
            done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        yield flush()

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
