"""Packing, vector codes and the Merkle manifest against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgeline.llm import merkle, packing, queries, toxicity, vector_codes

WORDS = P.path("word_bpe_49k.json")
CLASH = ["doc", "start", "row", "block", "ids", "tree", "index", "size", "leaf", "proof", "root"]


def frame(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    for c in CLASH:
        df = df if c in df.columns else df.withColumn(c, F.lit(f"own {c}"))
    return df


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    text = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    return [(i, text(r.randrange(1, 300))) for i in range(60)] + [(60, None), (61, ""), (None, text(9)), (62, text(6000)), (63, "same text"), (63, "same text"), (64, text(3))]


def test_packing_places_every_id_once(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    out = packing.pack(frame(spark, texts), WORDS, end_id=2, size=512).collect()
    want = Counter((i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, x in texts)
    docs, rooms = defaultdict(list), defaultdict(list)
    for r in out:
        docs[r.doc_id, r.doc_tokens].append(r)
        rooms[r.sequence_id].append(r)
    for (i, n), ids in [((i, len(b) // 4), b) for i, b in want]:
        copies = want[i, ids]
        some = sorted(docs[i, n], key=lambda r: r.start)
        assert sum(r.length for r in some) == n * copies
        joined = b"".join(bytes(r.ids) for r in some) if copies == 1 else None
        assert joined in (None, ids)
    for some in rooms.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at and len(r.ids) == 4 * r.length
            at += r.length
        assert at == 512 or at & (at - 1) == 0  # nothing is padded
    assert packing.pack(frame(spark, []), WORDS, end_id=2).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=80))
def test_assignment_is_whole_and_cuts_little(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    rooms = packing.capacities(int(lengths.sum()), 64)
    got = packing.assign(lengths, rooms)
    for i, n in enumerate(lengths.tolist()):
        mine = [x for x in got if x[0] == i]
        assert [x[1] for x in mine] == np.cumsum([0, *[x[2] for x in mine]]).tolist()[:-1] and sum(x[2] for x in mine) == n
    for s, room in enumerate(rooms.tolist()):
        assert sum(x[2] for x in got if x[3] == s) == room
    assert len(got) - len(lengths) <= len(rooms)


def test_assignment_balances_cost():
    got = packing.assign(np.array([60, 30, 30, 20, 20, 20]), np.array([64, 64, 64]))
    # the longest alone; equals go to the sequence that costs least so far
    assert [x[3] for x in got[:4]] == [0, 1, 2, 1] and got[4][3] == 2


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(kept rows, codes, errors, books) with Python's integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda x: (x[0] is None, x[0], x[1]))
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    ints = [[math.floor(x * 1024) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    w = width // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for v in ints[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        got = [[near(v, p)[1] for v in ints] for p in range(parts)]
        books = [[[sum(c) // len(c) for c in zip(*m)] if (m := [cut(v, p) for v, g in zip(ints, got[p]) if g == k]) else e for k, e in enumerate(books[p])] for p in range(parts)]
    found = [[near(v, p) for p in range(parts)] for v in ints]
    return kept, ["".join(f"{k:02x}" for _, k in f) for f in found], [sum(d for d, _ in f) for f in found], books


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_vector_codes_match_whole_numbers(spark, scale):
    """``scale`` 1e6 leaves the range of 64-bit sums."""
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) * scale for _ in range(10)], r.choice([0, 0, 0, 1, None])) for i in range(90)]
    rows += [(90, None, 1), (91, [1.0, None], 1), (92, [float("nan")] * 10, 0), (93, [float("inf")], 0), (94, [], 7), (95, [0.5] * 3, 7), (None, [0.25] * 10, 7), (3, [9.0] * 10, 7), (3, [9.0] * 10, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("own")).repartition(5)
    out, books = vector_codes.encode(df, entries=16)
    kept, codes, errors, want = plain_codes(rows, entries=16)
    by_label = defaultdict(int)
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] += e
    key = lambda x: str(x)
    fits = lambda e: e if e < 2**63 else None
    got = sorted(((x.vec_id, x.label, x.code, x.error, x.label_error) for x in out.collect()), key=key)
    assert got == sorted(((i, lab, c, fits(e), fits(by_label[lab])) for (i, _, lab), c, e in zip(kept, codes, errors)), key=key)
    assert [p.tolist() for p in books.parts] == want
    assert vector_codes.encode(df.limit(0))[0].count() == 0


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hashlib.sha256("".join(levels[-1][i : i + 3]).encode()).hexdigest() for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        run = range(i // 3 * 3, min(i // 3 * 3 + 3, len(level)))
        out.append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
        i //= 3
    return out


@pytest.mark.parametrize("window", [7, 100_000])
def test_proofs_lead_to_the_root(spark, monkeypatch, window):
    monkeypatch.setattr(merkle, "LEAVES", window)
    r = random.Random(2)
    rows = [(i, r.choice(["a", "a", "a", "b", None, "é", ""]), f"t{i}\nx") for i in range(120)] + [(None, "a", "x"), (5, "a", "again"), (6, "b", "twice"), (6, "b", "twice"), (7, "zz", None)]
    r.shuffle(rows)
    docs = frame(spark, rows, "doc_id long, source string, text string").drop("leaf").repartition(3)
    docs = docs.withColumn("leaf", merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("text")))
    out = merkle.prove(docs, more=["text", "root", "index"])
    out = out.withColumn("led", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for i, s, t in rows:
        leaf = hashlib.sha256((field(i) + field(s) + field(t)).encode()).hexdigest()
        groups[s].append((-1 if i is None else i, leaf, t))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in order]
    top = plain_tree([t[-1][0] for t in trees])
    want = []
    for k, s in enumerate(order):
        for j, (i, leaf, t) in enumerate(sorted(groups[s], key=lambda x: x[:2])):
            want.append((i, t, leaf, trees[k][-1][0], top[-1][0], plain_path(trees[k], j) + plain_path(top, k)))
    got = [(-1 if x.doc_id is None else x.doc_id, x.text, x.leaf, x.subroot, x.root, [tuple(s) for s in x.proof]) for x in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(x.led == x.root for x in out) and "index" in out[0].asDict()


def test_empty_and_single_leaf_manifests(spark):
    none = spark.createDataFrame([], "doc_id long, source string, leaf string")
    assert merkle.prove(none).count() == 0
    one = merkle.prove(spark.createDataFrame([(1, None, "ab")], none.schema)).first()
    assert (one.leaf, one.subroot, one.root, one.proof) == ("ab", "ab", "ab", [])


def test_merging_is_associative():
    nodes = [(t, 0, i, hashlib.sha256(f"{t}:{i}".encode()).hexdigest().encode()) for t in range(4) for i in range((t + 1) * 7)]
    sizes = {merkle.TOP: 4} | {t: (t + 1) * 7 for t in range(4)}
    r, roots = random.Random(4), set()
    for _ in range(20):
        some = r.sample(nodes, len(nodes))
        cuts = sorted(r.sample(range(len(some)), 3))
        parts = []
        for a, b in zip([0, *cuts], [*cuts, len(some)]):
            f = merkle.Forest(dict(sizes))
            for n in some[a:b]:
                f.add(*n)
            parts.append(f)
        while len(parts) > 1:
            a = parts.pop(r.randrange(len(parts)))
            parts[r.randrange(len(parts))].merge(a)
        assert len(parts[0].open) == 1
        roots.add(next(iter(parts[0].open.values())))
    assert len(roots) == 1


def test_tampering_with_line_ends_shows(spark, folder):
    out = queries.op13_merkle_manifest(spark, folder).collect()
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in out:
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (rows[r.doc_id] or "")
        assert r.verified == (not changed)
    assert any(not r.verified for r in out)


def test_training_needs_no_second_set_of_workers(spark, monkeypatch):
    """RDD tasks have Python workers of their own, beside the idle ones of SQL,
    and their blocks lie in the executors' heap; training has neither."""
    from pyspark import RDD

    def refuse(*_, **__):
        raise AssertionError("an RDD of Python objects")

    for name in ("mapPartitions", "treeAggregate", "persist"):
        monkeypatch.setattr(RDD, name, refuse)
    docs = spark.createDataFrame([(i, "plain words " + "vile scum " * (i % 2) + f"w{i}") for i in range(200)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"))
    tokens = [t.split() for t in ("a vile thing", "a plain thing")]
    got = model.scores(tokens, model.token_marginals(tokens))
    assert got[0] > got[1]
