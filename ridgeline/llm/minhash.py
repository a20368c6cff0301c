"""MinHash near-dedup with fast similarity sketches.

A sketch of ``t`` coordinates is filled in rounds.  In round r < t every
shingle is thrown into one hashed bin, with a value that ranks below those of
later rounds; a bin keeps its least value.  Rounds t..2t-1 throw all shingles
into bin r - t, so that every coordinate fills.  Coordinates of two sets agree
with the probability of their Jaccard similarity.  Sketches are cut into bands;
texts that agree on a whole band are candidates.

Texts with the same shingle set - by 128 bits of a keyed hash, whose key is
drawn per run - form one class, which only its smallest id represents.  Within
a band's bucket the first member is compared with all others.  Buckets whose
members are then still in different components are cut into blocks, and pairs
of blocks are compared in one task each: only pairs of different components, in
the first bucket that they share, whose sketches agree in enough places for the
similarity.  Members of a bucket's largest component meet only blocks of other
components, so a large component with a few outliers costs one copy per member.
Documents without such a pair drop out before texts are fetched; the rest are
compared block by block, and a block pair gives at most one link per merged
component.  Every link is confirmed on the words of both texts.  Nothing is
capped, and no pair is ever a row of a table unless it is a link or involves a
bucket's first member.

With 32 bands of 4 rows, a pair of similarity 0.8 shares no band with
probability 5e-8, and its sketches fail with probability ``MISS`` at most.

Defined results: a null or empty text has no shingles, links with nothing and
is its own component; a null id acts as one document before all others; rows
that share an id are one document and count as linked; an empty table gives an
empty table; a component is named by its smallest id, so ties cannot occur;
very long texts are whole sets in one worker.  Only id and text are read, so
other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import NULL_ID, as_bytes, id_key, result, slices, spool, tune, work_dir
from ridgeline.llm.components import components
from ridgeline.llm.shingles import Hasher, common_shingles, mix, new_key, overlap, shingle_sets

_U = np.uint64
#: Bytes of text that are hashed at once in a Python worker.
STEP_BYTES = 2 << 20
#: Members compared in one task with one copy of their pivot.
SHARE = 256
#: Bound for the probability that the sketches of a linked pair agree too little.
MISS = 1e-8
#: Members of a bucket, and bytes of their texts, that make one block.
BLOCK = 512
BLOCK_BYTES = 1 << 20


def least_agreement(t: int, percent: int) -> int:
    """Coordinates, of t, in which a pair of that similarity agrees at least,
    but for a probability of ``MISS``."""
    p, total = percent / 100, 0.0
    for x in range(t + 1):
        total += math.comb(t, x) * p**x * (1 - p) ** (t - x)
        if total > MISS:
            return x
    return t


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches of distinct shingle sets, one row each.

    Rows of empty sets are all ones.
    """
    bits = t.bit_length() - 1
    if t != 1 << bits:
        raise ValueError("the sketch size must be a power of two")
    full = _U(2**64 - 1)
    out = np.full((len(sets), t), full, np.uint64)
    todo = [i for i, s in enumerate(sets) if len(s)]
    value = _U((1 << (56 - bits)) - 1)
    for r in range(2 * t):
        if not todo:
            break
        lens = np.array([len(sets[i]) for i in todo])
        x = np.concatenate([sets[i] for i in todo])
        h = mix(x ^ _U((0xA0761D6478BD642F * (r + 1)) % 2**64))
        row = np.repeat(np.array(todo), lens)
        bin_ = (h >> _U(64 - bits)).astype(np.int64) if r < t else np.full(len(h), r - t)
        np.minimum.at(out.reshape(-1), row * t + bin_, (_U(r) << _U(56 - bits)) | ((h >> _U(4)) & value))
        todo = [i for i in todo if (out[i] == full).any()]
    return out


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One key per band and row of ``sketch``; keys of unlike bands differ."""
    n, t = sketch.shape
    parts = sketch.reshape(n, bands, t // bands)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for i in range(parts.shape[2]):
        key = mix(key * _U(0xE7037ED1A0B428DB) + parts[:, :, i])
    return key


def _sketcher(words: int, bands: int, rows: int, secret: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(secret)
        for batch in slices(batches, "text", STEP_BYTES):
            found = shingle_sets(as_bytes(batch.column(1)), words, hasher)
            sets = [s for s, _ in found]
            drawn = sketches(sets, bands * rows)
            keys = band_keys(drawn, bands).astype(np.int64)
            marks = pa.array([x.tobytes() for x in drawn.astype(np.uint8)], pa.binary())
            n = np.array([len(s) for s in sets], np.int64)
            f = np.frombuffer(b"".join(d for _, d in found), "<i8").reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
            columns = [batch.column(0), pa.array(n), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), lists, marks, batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "f1", "f2", "bands", "marks", "fp"])

    return run


def _linked(a: bytes, b: bytes, words: int, percent: int) -> bool:
    n, m, both = common_shingles(a, b, words)
    return both > 0 and 100 * both >= percent * (n + m - both)


def _agreeing(least: int):
    """Keep pairs whose sketches agree in at least ``least`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (4, 5))
            keep = pa.array((a == b).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(4)], names=["a", "fa", "b", "fb"])

    return run


def _pairs(key: int, left: list[dict], right: list[dict], least: int, percent: int) -> np.ndarray:
    """Positions (i, j) in two blocks of a bucket that must be verified."""
    same = left is right
    get = lambda rows, name, kind: np.array([r[name] for r in rows], kind)
    la, lb, na, nb = get(left, "label", np.int64), get(right, "label", np.int64), get(left, "n", np.int64), get(right, "n", np.int64)
    todo = la[:, None] != lb[None, :]
    todo &= 100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :])
    if same:
        todo &= np.triu(np.ones(todo.shape, bool), 1)
    at = np.argwhere(todo)
    if not len(at):
        return at
    ka, kb = get(left, "bands", np.int64), get(right, "bands", np.int64)
    ma, mb = (np.frombuffer(b"".join(r["marks"] for r in rows), np.uint8).reshape(len(rows), -1) for rows in (left, right))
    band = int(np.flatnonzero(ka[0] == key)[0])
    out = []
    for c in range(0, len(at), 20_000):
        i, j = at[c : c + 20_000].T
        ok = (ma[i] == mb[j]).sum(axis=1) >= least
        i, j = i[ok], j[ok]
        ok = ~(ka[i, :band] == kb[j, :band]).any(axis=1)
        out.append(np.stack([i[ok], j[ok]], axis=1))
    return np.concatenate(out)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict], list[dict]]]:
    """Groups of rows that come sorted by (key, bi, bj): key and two blocks."""
    now, rows = None, []

    def sides():
        key, bi, bj = now
        left = [r for r in rows if r["block"] == bi]
        return key, left, left if bi == bj else [r for r in rows if r["block"] == bj]

    for batch in batches:
        for r in batch.to_pylist():
            group = (r["key"], r["bi"], r["bj"])
            if group != now and rows:
                yield sides()
                rows = []
            now = group
            rows.append(r)
    if rows:
        yield sides()


def _candidates(least: int, percent: int):
    """(key, m, f1) of members with a pair to verify in that bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, left, right in _blocks(batches):
            at = _pairs(key, left, right, least, percent)
            some = {(r["m"], r["f1"]) for r in [*(left[i] for i in set(at[:, 0])), *(right[j] for j in set(at[:, 1]))]}
            m, f1 = [x for x, _ in some], [x for _, x in some]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([key] * len(m), m, f1)], names=["key", "m", "f1"])

    return run


def _linker(words: int, least: int, percent: int, secret: bytes):
    """Links (a, b) between components, confirmed on full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(secret)
        for key, left, right in _blocks(batches):
            at = _pairs(key, left, right, least, percent)
            texts = [[r["text"].encode() for r in rows] for rows in ((left,) if left is right else (left, right))]
            sets = [[s for s, _ in shingle_sets(x, words, hasher)] for x in texts]
            to: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := to.get(x, x)) != x:
                    to[x] = up = to.get(up, up)
                    x = up
                return x

            a, b = [], []
            for i, j in at.tolist():
                x, y = root(left[i]["label"]), root(right[j]["label"])
                if x == y:
                    continue
                p, q = sets[0][i], sets[-1][j]
                both = overlap(p, q)
                if 100 * both >= percent * (len(p) + len(q) - both) and _linked(texts[0][i], texts[-1][j], words, percent):
                    to[max(x, y)] = min(x, y)
                    a.append(left[i]["m"])
                    b.append(right[j]["m"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _paired_blocks(rows: DataFrame, size: Column) -> DataFrame:
    """Copy members (key, m, f1, label, ...) to the pairs of blocks of their
    bucket that hold unlike components.

    A member's block is drawn by its hash, so no task numbers a whole bucket;
    ``size`` of a bucket's members in all, by side, gives the number of blocks.
    Members of the largest component are one side and meet the other's blocks.
    """
    per = rows.groupBy("key", "label").agg(size.alias("size"), F.count("*").alias("n"))
    top = per.groupBy("key").agg(F.max_by(F.struct("label", "size"), F.struct("n", "label")).alias("top"), F.sum("size").alias("whole"), F.count("*").alias("labels"))
    cut = top.where("labels > 1").select("key", F.col("top.label").alias("top"), F.ceil("top.size").cast("int").alias("many"), F.ceil(F.col("whole") - F.col("top.size")).cast("int").alias("few"))
    rows = rows.join(cut.hint("merge"), "key").withColumn("side", F.col("label") == F.col("top"))
    drawn = F.xxhash64("m", "f1")
    block = F.when(F.col("side"), F.pmod(drawn, F.col("many"))).otherwise(F.col("many") + F.pmod(drawn, F.col("few"))).cast("int")
    first = F.when(F.col("side"), F.col("many")).otherwise(F.lit(0))
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(first, F.col("many") + F.col("few") - 1)))
    rows = rows.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other", "top", "many", "few", "side")
    return rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "block", "m", "f1")


def _verifier(words: int, percent: int, secret: bytes):
    """Rows come sorted by (a, salt, role): the pivot, then its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivot, whole, hasher = None, np.zeros(0, np.uint64), b"", Hasher(secret)
        for batch in slices(batches, "text", STEP_BYTES):
            texts = as_bytes(batch.column(batch.schema.get_field_index("text")))
            sets = [s for s, _ in shingle_sets(texts, words, hasher)]
            a, fa, b, salt, role = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "fa", "b", "salt", "role"))
            left, right = [], []
            for i, s in enumerate(sets):
                if role[i] == 0:
                    now, pivot, whole = (a[i], fa[i], salt[i]), s, texts[i]
                    continue
                if now != (a[i], fa[i], salt[i]):
                    raise RuntimeError("a member came without its pivot")
                both = overlap(pivot, s)
                if 100 * both >= percent * (len(pivot) + len(s) - both) and _linked(whole, texts[i], words, percent):
                    left.append(a[i])
                    right.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 4,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Two documents are linked if 100 * intersection >= ``percent`` * union of
    their sets of shingles of ``words`` words.
    """
    spark = docs.sparkSession
    tune(spark)
    root, secret = work_dir(spark, "minhash"), new_key()
    texts = docs.select(id_key(id_col).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.select("doc", "text", F.xxhash64("text").alias("fp"))
    drawn = spool(texts.mapInArrow(_sketcher(words, bands, rows, secret), "doc long, n long, f1 long, f2 long, bands array<long>, marks binary, fp long"), f"{root}/sketches")

    full = drawn.where("n > 0")
    # the row with the smallest id stands for its class
    reps = full.groupBy("f1", "f2").agg(F.min_by(F.struct("doc", "n", "bands", "marks", "fp"), "doc").alias("r"))
    reps = spool(reps.select("f1", "f2", "r.*"), f"{root}/classes")
    classes = reps.select("f1", "f2", F.col("doc").alias("rep"))
    keyed = reps.select(F.explode("bands").alias("key"), F.col("doc").alias("m"), "f1", "n")
    first = [F.min("m").alias("om"), F.min_by("f1", "m").alias("of"), F.min_by("n", "m").alias("on")]  # of one row, also where ids tie
    shared = keyed.groupBy("key").agg(F.count("*").alias("size"), *first).where("size > 1")
    members = spool(keyed.join(shared.hint("merge"), "key"), f"{root}/members")
    ends = reps.join(members.select(F.col("m").alias("doc"), "f1"), ["doc", "f1"], "left_semi").select("doc", "f1", "marks", "bands", "fp")
    ends = spool(ends, f"{root}/ends")
    held = spool(texts.join(ends.select("doc", "f1", "fp").hint("merge"), ["doc", "fp"]).select("doc", "f1", "text"), f"{root}/texts")

    twice = spool(drawn.groupBy("doc").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo <> hi").select("doc"), f"{root}/twice")
    links = spark.createDataFrame([], "a long, b long")
    if not twice.isEmpty():
        again = full.join(twice, "doc", "left_semi").join(classes, ["f1", "f2"]).select(F.col("doc").alias("a"), F.col("rep").alias("b"))
        links = spool(again.where("a <> b"), f"{root}/links_ids")

    # the first member of each bucket against the others
    least = least_agreement(bands * rows, percent)
    labels = components(spark, links, f"{root}/components") if not links.isEmpty() else None
    pairs = members.where("(om <> m OR of <> f1)").where(100 * F.least("on", "n") >= percent * F.greatest("on", "n"))
    pairs = pairs.select(F.col("om").alias("a"), F.col("of").alias("fa"), F.col("m").alias("b"), F.col("f1").alias("fb")).distinct()
    pairs = pairs.join(ends.select(F.col("doc").alias("a"), F.col("f1").alias("fa"), F.col("marks").alias("ma")), ["a", "fa"])
    pairs = pairs.join(ends.select(F.col("doc").alias("b"), F.col("f1").alias("fb"), F.col("marks").alias("mb")), ["b", "fb"])
    pairs = spool(pairs.select("a", "fa", "b", "fb", "ma", "mb").mapInArrow(_agreeing(least), "a long, fa long, b long, fb long"), f"{root}/pairs")
    found = spool(_verify(pairs, held, words, percent, secret), f"{root}/links")
    if not found.isEmpty():
        links = links.union(found)
        labels = components(spark, links, f"{root}/components1")

    # what is still apart in a bucket of three or more, block by block
    now = _labelled(members.where("size > 2").select("key", "m", "f1", "n"), labels)
    apart = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    now = spool(now.join(apart.hint("merge"), "key", "left_semi"), f"{root}/apart")
    if not now.isEmpty():
        marked = now.join(ends.select(F.col("doc").alias("m"), "f1", "marks", "bands"), ["m", "f1"])
        kept = _paired_blocks(marked, F.count("*") / BLOCK).mapInArrow(_candidates(least, percent), "key long, m long, f1 long").distinct()
        kept = spool(kept, f"{root}/candidates")
        if not kept.isEmpty():
            again = marked.join(kept, ["key", "m", "f1"], "left_semi").join(held.select(F.col("doc").alias("m"), "f1", "text"), ["m", "f1"])
            size = F.sum(F.octet_length("text")) / BLOCK_BYTES + F.count("*") / BLOCK
            found = spool(_paired_blocks(again, size).mapInArrow(_linker(words, least, percent, secret), "a long, b long").distinct(), f"{root}/links2")
            if not found.isEmpty():
                links = links.union(found)
                labels = components(spark, links, f"{root}/components2")

    if labels is None:
        labels = components(spark, links, f"{root}/components")
    ids = drawn.select("doc", "n", "f1", "f2").join(classes, ["f1", "f2"], "left").withColumn("node", F.coalesce("rep", "doc"))
    ids = ids.join(labels, "node", "left").select("doc", "n", F.coalesce("label", "node").alias("component"))
    ids = result(ids, root)
    return ids.select(
        F.nullif("doc", F.lit(NULL_ID)).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.nullif("component", F.lit(NULL_ID)).alias("component_id"),
        (F.col("doc") == F.col("component")).alias("kept"),
    )


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` with the label of the component they are in so far."""
    if labels is None:
        return members.withColumn("label", F.col("m"))
    named = labels.select(F.col("node").alias("m"), "label")
    return members.join(named, "m", "left").withColumn("label", F.coalesce("label", "m"))


def _verify(pairs: DataFrame, held: DataFrame, words: int, percent: int, secret: bytes) -> DataFrame:
    """Links among ``pairs`` (a, fa, b, fb); a pivot with many members is
    copied to as many shares, so that no task holds all of them."""
    spread = pairs.groupBy("a", "fa").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    pivots = spread.join(held.select(F.col("doc").alias("a"), F.col("f1").alias("fa"), "text"), ["a", "fa"])
    pivots = pivots.select("a", "fa", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.lit(0).alias("role"), "text")
    rest = pairs.join(spread, ["a", "fa"]).join(held.select(F.col("doc").alias("b"), F.col("f1").alias("fb"), "text"), ["b", "fb"])
    rest = rest.select("a", "fa", "b", F.pmod(F.hash("b", "fb"), F.col("shares")).alias("salt"), F.lit(1).alias("role"), "text")
    rows = pivots.union(rest).repartition("a", "fa", "salt").sortWithinPartitions("a", "fa", "salt", "role")
    return rows.mapInArrow(_verifier(words, percent, secret), "a long, b long")
