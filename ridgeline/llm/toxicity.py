"""Toxic spans by a linear-chain conditional random field.

Labels come per document.  Word and prefix features that occur mostly in toxic
documents mark tokens of the toxic training documents; a two-state chain with
word, prefix and suffix features is fitted to these tokens.  Forward-backward
marginals give each token's probability of being toxic; their sum and maximum
enter a logistic score of the document, which is fitted on documents kept out
of the chain's training and corrected for the shares of the labels.

Chains are stretches of at most ``CHAIN`` tokens, cut so that a batch is one
matrix; every token of a text is in one.

Training reads at most ``TRAIN_ROWS`` labelled documents per label, the first
by a hash of their id, and of these every word, however long the text.  Their
tokens stay in the executors: an epoch is one job that adds up gradients,
which are whole numbers of 2**-``FIXED``, so that the order of adding them up
changes nothing.  The driver holds the weights, whose number is fixed.

Defined results: null and empty texts have no tokens and the score of a text
without toxic tokens; without labels of both kinds, as in an empty table, every
score is 0; rows are scored by text alone, so repeated rows score alike; an id
with several labels is toxic if one of them says so, and of rows that share an
id the text of the least hash is learned from; ties of the hash order go by id;
a column ``score`` or ``toxic_spans`` of the input is replaced, all others stay.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import extended, slices, tune, with_columns

CHAIN = 64
BITS = 20
TRAIN_ROWS = 2500
EPOCHS = 40
FIXED = 32
#: Tokens of training texts that are one block, and of one task at least.
BLOCK, SHARE = 1 << 20, 1 << 17
#: Entries of a gradient that are added up together.
STRETCH = 1 << 13
MEMORY = 400_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def word_slots(token: str) -> list[int]:
    """Hashed features of one token between white space: the word, its last
    three characters, and prefixes of three to six."""
    w = _EDGE.sub("", token.lower())
    if not w:
        return [_slot("none")]
    return [_slot("w=" + w), _slot("s=" + w[-3:]), *(_slot(f"p{n}=" + w[:n]) for n in (3, 4, 5, 6) if len(w) > n)]


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def chains(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut documents of the given lengths into chains: (first token, length)."""
    per = -(-lengths // CHAIN)
    base = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    nth = np.arange(per.sum()) - np.repeat(np.concatenate([[0], np.cumsum(per)])[:-1], per)
    first = np.repeat(base, per) + nth * CHAIN
    return first, np.minimum(CHAIN, np.repeat(base + lengths, per) - first)


def marginals(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: float, pairs: bool = False):
    """Probability of state 1 per token; ``emit`` is its score against state 0.

    With ``pairs`` also the expected counts of the four transitions and of a
    chain that starts in state 1.
    """
    first, size = chains(lengths)
    n = len(first)
    out = np.zeros(len(emit))
    if not n:
        return (out, np.zeros((2, 2)), 0.0) if pairs else out
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]) + 1)]  # chains longer than t
    move = np.exp(trans)
    e = [np.exp(np.clip(emit[first[: live[t]] + t], -30, 30)) for t in range(int(size[0]))]
    fwd = []
    for t, x in enumerate(e):
        if t == 0:
            a0, a1 = np.ones(len(x)), np.exp(start) * x
        else:
            p0, p1 = fwd[-1][0][: len(x)], fwd[-1][1][: len(x)]
            a0, a1 = p0 * move[0, 0] + p1 * move[1, 0], (p0 * move[0, 1] + p1 * move[1, 1]) * x
        z = a0 + a1
        fwd.append((a0 / z, a1 / z))
    expected, b0, b1 = np.zeros((2, 2)), np.ones(0), np.ones(0)
    for t in range(len(e) - 1, -1, -1):
        n_t = len(e[t])
        f0, f1 = fwd[t]
        n0, n1 = np.ones(n_t), np.ones(n_t)
        if len(b0):
            m = len(b0)
            x = e[t + 1]
            n0[:m] = move[0, 0] * b0 + move[0, 1] * x * b1
            n1[:m] = move[1, 0] * b0 + move[1, 1] * x * b1
            if pairs:
                j = np.stack([f0[:m] * move[0, 0] * b0, f0[:m] * move[0, 1] * x * b1, f1[:m] * move[1, 0] * b0, f1[:m] * move[1, 1] * x * b1])
                expected += (j / j.sum(axis=0)).sum(axis=1).reshape(2, 2)
        z = n0 + n1
        b0, b1 = n0 / z, n1 / z
        g = f1 * b1
        out[first[:n_t] + t] = g / (g + f0 * b0)
    return (out, expected, float(out[first].sum())) if pairs else out


@dataclass
class Model:
    """A fitted chain and the logistic score over its marginals."""

    weights: np.ndarray
    trans: np.ndarray
    start: float
    doc: np.ndarray
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def emission(self, token: str) -> float:
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            got = float(sum(self.weights[i] for i in word_slots(token)))
            if len(token) <= 64:
                self.known[token] = got
        return got

    def token_marginals(self, tokens: list[list[str]]) -> np.ndarray:
        """Probability of toxic of all tokens, text after text."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        emit = np.fromiter((self.emission(w) for t in tokens for w in t), np.float64, int(lengths.sum()))
        return marginals(emit, lengths, self.trans, self.start)

    def scores(self, tokens: list[list[str]], p: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_summaries(tokens, p) @ self.doc, -40, 40)))


def _summaries(tokens: list[list[str]], p: np.ndarray) -> np.ndarray:
    """Per document: 1; whether at least one, two and three different words
    are toxic; the highest marginal; the sum over different words.

    A word that is repeated counts once, with its highest marginal.
    """
    out = np.zeros((len(tokens), 6))
    out[:, 0] = 1
    at = 0
    for row, words in zip(out, tokens):
        here = p[at : at + len(words)]
        at += len(words)
        best: dict[str, float] = {}
        for i in np.flatnonzero(here >= 0.2).tolist():
            w = _EDGE.sub("", words[i].lower())
            best[w] = max(best.get(w, 0.0), float(here[i]))
        bad = sum(v >= 0.5 for v in best.values())
        row[1:] = bad >= 1, bad >= 2, bad >= 3, max(best.values(), default=0.0), min(6.0, sum(best.values()))
    return out


def _nothing() -> Model:
    return Model(np.zeros(1 << BITS, np.float32), np.zeros((2, 2)), 0.0, np.array([-40.0, 0, 0, 0, 0, 0]))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, tokens, slots) of (y, text): every token as the number of its word
    in the text, and the words' slots."""
    for batch in slices(batches, "text", 2 << 20):
        tokens, found = [], []
        for text in batch.column(1).to_pylist():
            ids: dict[str, int] = {}
            tokens.append(np.fromiter((ids.setdefault(w, len(ids)) for w in text.split()), np.int32).tobytes())
            table = np.full((len(ids), 6), 1 << BITS, np.int32)  # a slot whose weight stays zero
            for w, i in ids.items():
                some = word_slots(w)
                table[i, : len(some)] = some
            found.append(table.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.binary()), pa.array(found, pa.binary())], names=["y", "tokens", "slots"])


def _table(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32).reshape(-1, 6)


def _count_hints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n0, n1) of a task: its documents of either label by word and
    prefix slots; other slots that occur have none."""
    acc, seen = np.zeros((2, (1 << BITS) + 1), np.int32), np.zeros((1 << BITS) + 1, bool)
    for batch in batches:
        for y, raw in zip(batch.column(0).to_pylist(), batch.column(2)):
            slots = _table(raw.as_buffer())
            acc[y, np.unique(slots[:, [0, 2, 3, 4, 5]])] += 1
            seen[slots] = True
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(acc[0, at].astype(np.int64)), pa.array(acc[1, at].astype(np.int64))], names=["slot", "n0", "n1"])


@dataclass
class _Block:
    """Tokens of training texts, or of whole chains of one: texts' lengths, the
    tokens' words, marks and weights, the words' slots."""

    lengths: np.ndarray
    flat: np.ndarray
    y: np.ndarray
    importance: np.ndarray
    slots: np.ndarray

    @classmethod
    def made(cls, docs: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], used: np.ndarray, seed: np.ndarray, up: float) -> _Block:
        """Of ``docs`` (label, tokens, slots, tokens by word)."""
        base = np.cumsum([0, *(len(t) for _, _, t, _ in docs)])
        lengths = np.array([len(d) for _, d, _, _ in docs], np.int64)
        flat = np.concatenate([d + b for (_, d, _, _), b in zip(docs, base)]).astype(np.int32)
        slots, times = (np.concatenate([d[i] for d in docs]) for i in (2, 3))
        toxic = np.repeat(np.array([d[0] for d in docs], np.int8), lengths)
        y = seed[slots[:, [0, 2, 3, 4, 5]]].any(axis=1)[flat] & (toxic == 1)
        # a toxic document counts as in the population, a word once per document
        importance = np.where(toxic == 1, up, 1.0) / times[flat]
        return cls(lengths, flat, y.astype(np.uint8), importance, np.searchsorted(used, slots).astype(np.int32))

    @classmethod
    def read(cls, row: list[pa.Scalar]) -> _Block:
        parts = [np.frombuffer(c.as_buffer(), t) for c, t in zip(row, _KINDS.values())]
        return cls(*parts[:-1], parts[-1].reshape(-1, 6))

    def gradient(self, w: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Of the weights, the transitions and the start; and the chains."""
        y = self.y.astype(np.float64)
        first, _ = chains(self.lengths)
        inner = np.ones(len(self.flat), bool)
        inner[first] = False
        after = np.flatnonzero(inner)
        observed = np.bincount(2 * self.y[after - 1] + self.y[after], minlength=4)
        emit = w[self.slots].sum(axis=1)[self.flat]
        p, expected, starts = marginals(emit, self.lengths, theta[:4].reshape(2, 2), theta[4], pairs=True)
        per_word = np.bincount(self.flat, (y - p) * self.importance, minlength=len(self.slots))
        g = np.bincount(self.slots.reshape(-1), np.repeat(per_word, 6), minlength=len(w))
        more = [*(observed - expected.reshape(-1)), y[first].sum() - starts, len(first)]
        return np.rint(np.concatenate([g, more]) * 2.0**FIXED).astype(np.int64)


#: Columns of a block's row and what their bytes are.
_KINDS = {"lengths": np.int64, "flat": np.int32, "y": np.uint8, "importance": np.float64, "slots": np.int32}


def _added(parts: pa.Table) -> pa.Table:
    """One stretch of the tasks' sums (at, value)."""
    total = sum(np.frombuffer(v.as_buffer(), np.int64) for v in parts.column(1))
    return pa.table({"at": parts.column(0).slice(0, 1), "value": pa.array([total.tobytes()], pa.binary())})


def _sum_gradients(made: DataFrame, w: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Gradients of all blocks: each task adds up its own, and each stretch of
    the tasks' sums is added up by itself."""
    now = made.sparkSession.sparkContext.broadcast((w, theta))
    n = len(w) + 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(n, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                acc += _Block.read([c[i] for c in batch.columns]).gradient(*now.value)
        at = list(range(0, n, STRETCH))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([acc[a : a + STRETCH].tobytes() for a in at], pa.binary())], names=["at", "value"])

    total = np.zeros(n, np.int64)
    for r in made.mapInArrow(run, "at long, value binary").groupBy("at").applyInArrow(_added, "at long, value binary").collect():
        some = np.frombuffer(r["value"], np.int64)
        total[r["at"] : r["at"] + len(some)] = some
    now.destroy()
    return total / 2.0**FIXED


def fit(rows: DataFrame, prior: float) -> Model:
    """Fit on training texts (y, fits, text): the chain on those with ``fits``,
    the document score on the others.

    All passes run in the session's SQL workers, and what is read again lies on
    the executors' disks: a second set of workers and blocks in the executors'
    heap would stay there beside the first.
    """
    spark = rows.sparkSession
    tune(spark)
    kept = rows.where("fits").select("y", "text").mapInArrow(_encode, "y int, tokens binary, slots binary").persist(StorageLevel.DISK_ONLY)
    held = kept.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.length("tokens") / 4).alias("tokens")).collect()
    n = {r["y"]: r["n"] for r in held}
    if len(n) < 2:
        kept.unpersist()
        return _nothing()
    # tasks by tokens, as every epoch runs all of them
    own = kept.coalesce(1 + int(sum(r["tokens"] for r in held)) // SHARE)
    seen = own.mapInArrow(_count_hints, "slot long, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).orderBy("slot").toArrow()
    used = seen.column("slot").to_numpy()
    counts = [seen.column(c).to_numpy() for c in ("n0", "n1")]
    # share of toxic documents among those with the feature, as in the population
    up = prior / (1 - prior) * (n[0] + 1) / (n[1] + 1)
    seed = np.zeros((1 << BITS) + 1, bool)
    seed[used] = (counts[1] >= 4) & (up * (counts[1] - 1.0) > counts[0] + 1.0)
    seed[-1] = False
    used = used[used < 1 << BITS]
    shared = spark.sparkContext.broadcast((used, seed))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def packed() -> pa.RecordBatch:
            b = _Block.made(held, *shared.value, up)
            return pa.RecordBatch.from_arrays([pa.array([getattr(b, k).tobytes()], pa.binary()) for k in _KINDS], names=list(_KINDS))

        for batch in batches:
            for y, t, s in zip(*(batch.column(i) for i in range(3))):
                tokens, slots = np.frombuffer(t.as_buffer(), np.int32), _table(s.as_buffer())
                times = np.bincount(tokens, minlength=len(slots))
                for a in range(0, len(tokens), BLOCK):  # a multiple of the chains' length
                    held.append((y.as_py(), tokens[a : a + BLOCK], slots, times))
                    total += len(held[-1][1])
                    if total >= BLOCK:
                        yield packed()
                        held, total = [], 0
        if held:
            yield packed()

    made = own.mapInArrow(blocks, ", ".join(f"{k} binary" for k in _KINDS)).persist(StorageLevel.DISK_ONLY)
    w = np.zeros(len(used) + 1)  # the last is of the slot that stays zero
    grad2, grad2t = np.full(len(w), 1e-6), np.full(5, 1e-6)
    theta = np.array([0.0, -3.0, 0.0, -1.0, -3.0])
    for _ in range(EPOCHS):
        total = _sum_gradients(made, w, theta)
        g = total[: len(w)] - 0.01 * w
        g[-1] = 0
        grad2 += g * g
        w = w + 0.5 * g / np.sqrt(grad2)
        gt = total[len(w) : -1] / max(1.0, total[-1]) - 0.001 * theta
        grad2t += gt * gt
        theta = theta + 0.2 * gt / np.sqrt(grad2t)
    made.unpersist()
    kept.unpersist()
    shared.destroy()
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w[:-1]
    model = Model(weights, theta[:4].reshape(2, 2).copy(), float(theta[4]), np.zeros(6))
    sent = spark.sparkContext.broadcast(model)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            tokens = [t.split() for t in batch.column(1).to_pylist()]
            x = _summaries(tokens, sent.value.token_marginals(tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.where("NOT fits").select("y", "text").mapInArrow(summed, "y int, x array<double>").orderBy("y", "x").collect()  # a quarter of the training rows
    if not got:
        return _nothing()
    x, t = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)
    share = np.where(t == 1, prior, 1 - prior) / np.where(t == 1, max(t.sum(), 1), max((1 - t).sum(), 1))
    model.doc = _logistic(x, t, share * len(t))
    return model


def _logistic(x: np.ndarray, t: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, halved until they help."""
    ridge = np.array([1e-3] + [0.1] * (x.shape[1] - 1))

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(weight @ (np.logaddexp(0, z) - t * z) + 0.5 * ridge @ (b * b))

    b = np.zeros(x.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        g = x.T @ (weight * (t - q)) - ridge * b
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        while loss(b + step) > loss(b) and np.abs(step).max() > 1e-9:
            step = step / 2
        b = b + step
        if np.abs(step).max() < 1e-7:
            break
    return b


def in_training(doc_id: Column) -> Column:
    """Rows that may be learned from: crc32 of the id as text, mod 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs``."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where(in_training(F.col("id")) & F.col("y").isin(0, 1))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = (F.xxhash64("id"), F.col("id"))
    some = [known.where(F.col("y") == y).orderBy(*order).limit(TRAIN_ROWS) for y in (0, 1)]
    place = F.row_number().over(Window.orderBy(*order))  # of 2 * TRAIN_ROWS ids at most
    sample = some[0].union(some[1]).withColumn("fits", place % 4 != 0)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(sample), "id").where("text is not null")
    rows = rows.groupBy("id", "y", "fits").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    return fit(rows.select("y", "fits", "text"), min(max(prior, 1e-4), 1 - 1e-4))


def score(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = False) -> DataFrame:
    """``docs`` with ``score`` and, on demand, ``toxic_spans``: code point
    offsets (start, end) of tokens with a marginal of at least one half."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)
    found_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, text_col, 2 << 20):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            tokens = [(t or "").split() for t in texts]
            p = m.token_marginals(tokens)
            new = {"score": pa.array(m.scores(tokens, p))}
            if spans:
                at, found = 0, []
                for text, n in zip(texts, map(len, tokens)):
                    bad = set(np.flatnonzero(p[at : at + n] >= 0.5).tolist())
                    at += n
                    found.append([{"start": x.start(), "end": x.end()} for i, x in enumerate(re.finditer(r"\S+", text or "")) if i in bad] if bad else [])
                new["toxic_spans"] = pa.array(found, arrow_type)
            yield with_columns(batch, new)

    more = [("score", T.DoubleType())] + ([("toxic_spans", found_type)] if spans else [])
    return docs.mapInArrow(run, extended(docs.schema, *more))
