"""Substring dedup by collinear chaining of shared k-mer seeds.

Seeds are the least of every ``window`` consecutive hashes of k words, so that
texts with ``window + k - 1`` words in common have a seed in common.  All
occurrences of a seed are paired with its owner, the smallest document that has
it, so a passage of a million documents gives a million anchors and no pairs
among copies.  An owner may share less than a stretch that counts, so they are
also paired with the owner of the seed together with the first seed ``piece``
words on: whoever owns both has a stretch, unless the words between differ.
The anchors of a pair of documents are chained in both orders at
once, with a cost for gaps, by dynamic programming over a Fenwick tree of
prefix maxima.  Chains are then aligned on the words: gaps between anchors by
edit distance, both ends word by word until mismatches outweigh matches.

Aligned stretches of at least ``piece`` words are laid over each document, and
stretches that touch are joined, since parts of one passage may have different
owners.  What is at least ``least`` words long is a repeated passage.

Defined results: words are split at white space, A-Z lower-cased; null, empty
and short texts give no rows; a passage that a document shares with another is
found at every place, one that no other document has at none; rows that share
an id are one document, with the text of the least hash among them; a null id
acts as one document; of documents tied as owner the smallest id is it; very
long texts are whole in one worker; an empty table gives an empty table.  Only
id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import NULL_ID, as_bytes, id_key, result, slices, spool, tune, work_dir
from ridgeline.llm.shingles import Hasher, new_key, windows

STEP_BYTES = 2 << 20
#: Cost of a word of gap, against 1 for an anchor.
GAP = 0.01
#: Words between anchors that alignment bridges.
BRIDGE = 64
#: Pairs in one task with one copy of their owner's text.
SHARE = 64
#: Parts of a document's stretches that are joined before all of them.
PARTS = 32
#: Rows of repeated ids that may be broadcast.
FEW = 100_000
#: More than the words from a seed to its second one.
STEP = 1 << 16
#: Falls of the score by which an end is given up.
DROP = 8


def minimisers(hashes: np.ndarray, at: np.ndarray, k: int, window: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of all texts (text ``i`` has the words from ``at[i]`` to
    ``at[i + 1]``): the number of their text, the seed, where it occurs, and how
    far on the first seed is that ends ``piece`` words or more on, with a hash
    of both (-1 if there is none).  Of places of one seed that overlap, every
    k-th word has one."""
    none = np.zeros(0, np.int64)
    h = windows(hashes, k)
    if not len(h):
        return none, none.astype(np.uint64), none, none, none
    first, last = at[:-1], at[1:] - k  # of the k-grams inside a text
    chosen = [np.array([int(a + h[a : b + 1].argmin()) for a, b in zip(first, last) if 0 <= b - a < window], np.int64)]
    if len(h) >= window:
        view = np.lib.stride_tricks.sliding_window_view(h, window)
        low = view.argmin(axis=1) + np.arange(len(view))
        text = np.searchsorted(at, np.arange(len(view)), side="right") - 1
        chosen.append(low[np.arange(len(view)) + window - 1 <= last[text]])
    places = np.unique(np.concatenate(chosen))
    if not len(places):
        return none, none.astype(np.uint64), none, none, none
    text = np.searchsorted(at, places, side="right") - 1
    order = np.lexsort((places, h[places], text))
    pos, seeds, text = places[order], h[places][order], text[order]
    # a run of overlapping places is of a text that repeats within k words
    new = np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (text[1:] != text[:-1]) | (np.diff(pos) >= k)])
    stretch = (pos - pos[np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))]) // k
    keep = new | np.concatenate([[True], stretch[1:] != stretch[:-1]])
    pos, seeds, text = pos[keep], seeds[keep], text[keep]
    there = np.searchsorted(places, pos + max(1, piece - k))
    far = places[np.minimum(there, len(places) - 1)]
    some = (there < len(places)) & (far <= last[text])
    both = (windows(np.stack([seeds, h[far]], axis=1).ravel(), 2)[::2] >> np.uint64(33)).astype(np.int64)
    return text, seeds, pos - at[text], np.where(some, far - pos, 0), np.where(some, both, -1)


def chain(a: list[int], b: list[int], gap: float = GAP) -> list[list[int]]:
    """Chains of anchors (a[i], b[i]) that rise in both, best first.

    ``a`` is sorted.  A chain scores one per anchor less ``gap`` per word, in
    either text, from anchor to anchor; every anchor is in one chain at most.
    """
    n = len(a)
    rank = {v: r + 1 for r, v in enumerate(sorted(set(b)))}
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(rank) + 1)
    score, before = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        same = i
        while same < n and a[same] == a[i]:
            same += 1
        # anchors at the same place of ``a`` do not follow each other
        for j in range(i, same):
            best, r = (0.0, -1), rank[b[j]] - 1
            while r > 0:
                if tree[r][1] >= 0 and (best[1] < 0 or tree[r][0] > best[0]):
                    best = tree[r]
                r &= r - 1
            gain = best[0] - gap * (a[j] + b[j]) if best[1] >= 0 else 0.0
            score[j], before[j] = (1 + gain, best[1]) if gain > 0 else (1.0, -1)
        for j in range(i, same):
            value, r = (score[j] + gap * (a[j] + b[j]), j), rank[b[j]]
            while r < len(tree):
                if tree[r][1] < 0 or value[0] > tree[r][0]:
                    tree[r] = value
                r += r & -r
        i = same
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda x: -score[x]):
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = before[j]
        if path:
            out.append(path[::-1])
    return out


def edits(x: np.ndarray, y: np.ndarray) -> int:
    """Edit distance of two short word sequences."""
    if len(x) == len(y) and (x == y).all():
        return 0
    if not len(x) or not len(y):
        return max(len(x), len(y))
    row = np.arange(len(y) + 1)
    steps = np.arange(len(y) + 1)
    for i, w in enumerate(x, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (y != w))
        new = np.concatenate([[i], new])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def _alike(x: np.ndarray, y: np.ndarray) -> int:
    """Number of words that two sequences have alike at their beginning."""
    n, at, size = min(len(x), len(y)), 0, 32
    while at < n:
        end = min(n, at + size)
        differ = x[at:end] != y[at:end]
        if differ.any():
            return at + int(differ.argmax())
        at, size = end, 4 * size
    return n


def _extend(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """How far two word sequences go on alike, with single edits."""
    i = j = score = best = 0
    end = (0, 0)
    n, m = len(x), len(y)
    while i < n and j < m and score > best - DROP:
        if x[i] == y[j]:
            run = _alike(x[i:], y[j:])
            i, j, score = i + run, j + run, score + run
            if score > best:
                best, end = score, (i, j)
            continue
        score -= 2
        if i + 1 < n and j + 1 < m and x[i + 1] == y[j + 1]:
            i, j = i + 1, j + 1
        elif i + 1 < n and x[i + 1] == y[j]:
            i += 1
        elif j + 1 < m and x[i] == y[j + 1]:
            j += 1
        else:
            i, j = i + 1, j + 1
    return end


def align(x: np.ndarray, y: np.ndarray, a: list[int], b: list[int], k: int, identity: float) -> list[tuple[int, int, int, int]]:
    """Stretches (begin, end, begin, end) that texts ``x`` and ``y`` share
    along one chain."""
    out = []
    x0, y0, x1, y1, bad = a[0], b[0], a[0] + k, b[0] + k, 0

    def close() -> None:
        left = _extend(x[:x0][::-1], y[:y0][::-1])
        right = _extend(x[x1:], y[y1:])
        out.append((x0 - left[0], x1 + right[0], y0 - left[1], y1 + right[1]))

    for p, q in zip(a[1:], b[1:]):
        cost = 0
        if p > x1 or q > y1:
            if p - x1 > BRIDGE or q - y1 > BRIDGE:
                cost = -1
            elif p >= x1 and q >= y1:
                cost = edits(x[x1:p], y[y1:q])
            else:
                cost = abs((p - x1) - (q - y1))
        elif p - x1 != q - y1:
            cost = abs((p - x1) - (q - y1))
        if cost < 0 or bad + cost > (1 - identity) * (p + k - x0):
            close()
            x0, y0, bad = p, q, 0
        else:
            bad += cost
        x1, y1 = p + k, q + k
    close()
    return out


def _seeder(k: int, window: int, piece: int, secret: bytes):
    """``at`` is the place times ``STEP`` plus how far on the second seed is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(secret)
        for batch in slices(batches, "text", STEP_BYTES):
            hashes, at = hasher.words(as_bytes(batch.column(1)))
            hashes = np.ascontiguousarray(hashes[:, 0])
            text, seeds, pos, step, both = minimisers(hashes, at, k, window, piece)
            docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            columns = [seeds.astype(np.int64), both.astype(np.int32), docs[text], pos * STEP + step]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["seed", "both", "doc", "at"])

    return run


def _partner(seeds: DataFrame, key: list[str], name: str) -> DataFrame:
    """Add the place to pair a row with: the key's first place, or for other
    places of its document the first in the next document; null if none."""
    over, place = Window.partitionBy(*key), F.struct("doc", "at")
    out = seeds.withColumn("o", F.min(place).over(over))
    out = out.withColumn("n", F.min(F.when(F.col("doc") != F.col("o.doc"), place)).over(over))
    out = out.withColumn(name, F.when(F.col("doc") != F.col("o.doc"), F.col("o")).when(F.col("at") != F.col("o.at"), F.col("n")))
    return out.drop("o", "n")


def _anchors(seeds: DataFrame) -> DataFrame:
    """Anchors (a, b, pa, pb), ``a`` before ``b``; some come twice."""
    last = F.max("doc").over(Window.partitionBy("seed"))
    x = _partner(seeds.withColumn("last", last).withColumn("first", F.min("doc").over(Window.partitionBy("seed"))).where("first <> last").drop("first", "last"), ["seed"], "one")
    x = _partner(x, ["seed", "both"], "two").withColumn("two", F.when(F.col("both") >= 0, F.col("two")))

    def anchor(other: str, far: bool) -> Column:
        at = lambda c: F.floor(c / STEP) if not far else F.floor(c / STEP) + c % STEP
        mine, its = at(F.col("at")).cast("int"), at(F.col(f"{other}.at")).cast("int")
        swap = F.col("doc") < F.col(f"{other}.doc")
        made = F.struct(
            F.least("doc", f"{other}.doc").alias("a"), F.greatest("doc", f"{other}.doc").alias("b"), F.when(swap, mine).otherwise(its).alias("pa"), F.when(swap, its).otherwise(mine).alias("pb")
        )
        return F.when(F.col(other).isNotNull(), made)

    new = F.when(F.col("one").isNull() | (F.col("one") != F.col("two")), anchor("two", False))
    every = F.array(anchor("one", False), new, anchor("two", True))
    return x.select(F.explode(F.filter(every, lambda v: v.isNotNull())).alias("v")).select("v.*")


def _chainer(k: int, piece: int, window: int):
    """Rows come sorted by (a, b, pa, pb); one row per pair with its chains."""
    # a stretch of ``piece`` words may have its first and last seed this far in
    least = max(k, piece - 2 * (window - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x, y = None, [], []
        out: list[tuple[int, int, list[list[int]]]] = []

        def close() -> None:
            flat = []
            for c in chain(x, y):
                # in text that repeats, one side of a chain may stand nearly still
                if max(x[c[-1]] - x[c[0]], y[c[-1]] - y[c[0]]) + k >= least:
                    flat.append([v for i in c for v in (x[i], y[i])])
            if flat:
                out.append((*now, flat))

        def batch_of() -> pa.RecordBatch:
            a, b, c = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.list_(pa.list_(pa.int32())))], names=["a", "b", "chains"])

        for batch in batches:
            for a, b, p, q in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (a, b) != now:
                    if now is not None:
                        close()
                    now, x, y = (a, b), [], []
                elif x[-1] == p and y[-1] == q:
                    continue
                x.append(p)
                y.append(q)
            if out:
                yield batch_of()
        if now is not None:
            close()
        if out:
            yield batch_of()

    return run


def _aligner(k: int, piece: int, identity: float, secret: bytes):
    """Rows come sorted by (a, salt, role): the owner's text, then its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, owner, hasher = None, np.zeros(0, np.uint64), Hasher(secret)
        for batch in slices(batches, "text", STEP_BYTES):
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            hashes, at = hasher.words(as_bytes(col["text"]))
            hashes = np.ascontiguousarray(hashes[:, 0])
            rows = zip(*(col[n].to_pylist() for n in ("a", "salt", "role", "b", "chains")))
            out: list[tuple[int, int, int, int]] = []
            for i, (a, salt, role, b, chains) in enumerate(rows):
                text = hashes[at[i] : at[i + 1]]
                if role == 0:
                    now, owner = (a, salt), text.copy()
                    continue
                if now != (a, salt):
                    raise RuntimeError("a pair came without its owner")
                for c in chains:
                    for x0, x1, y0, y1 in align(owner, text, c[::2], c[1::2], k, identity):
                        if min(x1 - x0, y1 - y0) >= piece:
                            out += [(a, x0, x1, b), (b, y0, y1, a)]
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "begin", "end", "other"])

    return run


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = 51,
    piece: int = 20,
    k: int = 5,
    window: int = 4,
    identity: float = 0.8,
) -> DataFrame:
    """One row per document and repeated passage: id, ``begin`` and ``end`` in
    words (end exclusive), ``n_words``, the smallest other document that has a
    part of it, and the number of stretches found."""
    spark = docs.sparkSession
    tune(spark)
    root, secret = work_dir(spark, "substrings"), new_key()
    texts = docs.select(id_key(id_col).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    again = texts.select("doc", F.xxhash64("text").alias("h")).groupBy("doc").agg(F.min("h").alias("h"), F.count("*").alias("n")).where("n > 1")
    again = spool(again.select("doc", "h"), f"{root}/again")
    if n := again.count():
        # one row per id that comes more than once, then all others
        some = texts.join(F.broadcast(again) if n <= FEW else again, "doc", "left")
        one = some.where("h is not null AND xxhash64(text) = h").dropDuplicates(["doc"])
        texts = some.where("h is null").union(one).select("doc", "text")
    seeds = texts.mapInArrow(_seeder(k, window, piece, secret), "seed long, both int, doc long, at long")
    anchors = _anchors(seeds).repartition("a", "b").sortWithinPartitions("a", "b", "pa", "pb")
    pairs = spool(anchors.mapInArrow(_chainer(k, piece, window), "a long, b long, chains array<array<int>>"), f"{root}/pairs")

    wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    held = spool(texts.join(wanted, "doc", "left_semi"), f"{root}/texts")
    # written first, so that the join by owner can be split where an owner has many pairs
    spread = spool(pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")), f"{root}/shares")
    none = F.lit(None).cast("array<array<int>>")
    front = spread.join(held.withColumnRenamed("doc", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.lit(0).alias("role"), F.lit(0).cast("long").alias("b"), none.alias("chains"), "text"
    )
    rest = pairs.join(spread.hint("merge"), "a").join(held.withColumnRenamed("doc", "b"), "b")
    rest = rest.select("a", F.pmod(F.xxhash64("b"), F.col("shares")).alias("salt"), F.lit(1).alias("role"), "b", "chains", "text")
    rows = front.union(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    found = rows.mapInArrow(_aligner(k, piece, identity, secret), "doc long, begin long, end long, other long")
    found = found.groupBy("doc", "begin", "end").agg(F.min("other").alias("other"), F.count("*").alias("n"))

    # parts of a document's stretches are joined first, so that no task sees all
    found = _joined(found.withColumn("part", F.pmod(F.xxhash64("begin", "end"), F.lit(PARTS))), ["doc", "part"])
    out = _joined(found, ["doc"]).where(F.col("end") - F.col("begin") >= least).select(
        F.nullif("doc", F.lit(NULL_ID)).alias(id_col), "begin", "end", (F.col("end") - F.col("begin")).alias("n_words"),
        F.nullif("other", F.lit(NULL_ID)).alias("other_id"), F.col("n").alias("n_stretches"),
    )
    return result(out, root)


def _joined(found: DataFrame, by: list[str]) -> DataFrame:
    """Stretches (doc, begin, end, other, n) with those that touch joined."""
    order = Window.partitionBy(*by).orderBy("begin", "end")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", (F.coalesce(upto, F.lit(-1).cast("long")) < F.col("begin")).cast("int"))
    found = found.withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return found.groupBy(*by, "passage").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("other").alias("other"), F.sum("n").alias("n")).drop("passage")
