import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import bpe, chat, pii, quality, queries, rans, toxicity
from ridgeline.llm.common import table
from ridgeline.llm.components import components
from ridgeline.llm.decontam import contamination, decontaminate
from ridgeline.llm.line_dedup import LineStore, dedup_lines
from ridgeline.llm.minhash import _paired_blocks, least_agreement, near_duplicates, sketches
from ridgeline.llm.queries import op3_pii, op6_byte_bpe, op7_toxicity, op9_token_files, op10_quality_rules
from ridgeline.llm.shingles import common_shingles
from ridgeline.llm.substrings import align, chain, edits, repeated_passages

from . import brute

RANKS, PATTERN = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
CLASH = ["key", "part", "n_lines", "m", "p", "base", "words", "marks", "score", "ids", "spans", "doc", "fp"]


def words(rnd, n, vocab=400):
    return [f"w{rnd.randrange(vocab)}x" for _ in range(n)]


def frame(spark, rows, clash=True):
    """Documents with columns whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASH if clash else []:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


@pytest.fixture(scope="module")
def corpus():
    """Random texts with copies, near copies, shared lines; nulls and empties."""
    r = random.Random(5)
    lines = [" ".join(words(r, 6)) for _ in range(12)]
    out = []
    for i in range(60):
        body = [" ".join(words(r, r.randrange(3, 14))) for _ in range(r.randrange(1, 5))] + r.sample(lines, 2)
        r.shuffle(body)
        out.append((i, "\n".join(body)))
    for i in range(60, 75):
        w = out[i - 60][1].split(" ")
        w[len(w) // 2] = "changed"
        out.append((i, " ".join(w)))
    out += [(75, out[3][1]), (76, out[3][1].upper()), (77, None), (78, ""), (79, " \t\n"), (80, "two words"), (81, "Two  words"), (82, "x" * 5000), (83, " ".join(words(r, 6000)))]
    return out


def test_lines_match_brute_force(spark, corpus):
    rows = [*corpus, (None, corpus[0][1]), corpus[1]]
    out = dedup_lines(frame(spark, rows), batches=3, fanout=2)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_dropped, r.text or "") for r in out.collect())
    assert got == sorted((i if i is not None else -1, a, b, t) for i, a, b, t in brute.lines(rows))
    assert set(CLASH) <= set(out.columns) and out.first()["key"] == "own key"


def test_stored_runs_are_merged_without_shuffle_or_sort(spark, tmp_path, monkeypatch):
    """Plans of the anti-join and the merge read runs as they lie."""
    seen = []
    real = LineStore._add

    def add(self, level, entries):
        seen.append((level, len(self.runs()), entries._jdf.queryExecution().executedPlan().toString()))
        return real(self, level, entries)

    monkeypatch.setattr(LineStore, "_add", add)
    rows = [(i, f"a line of text number {i % 7}\nanother line of text {i % 5}") for i in range(200)]
    got = {(r.doc_id, r.text or "") for r in dedup_lines(frame(spark, rows), batches=4).collect()}
    assert got == {(i, t) for i, _, _, t in brute.lines(rows)}
    merges = [p for level, _, p in seen if level > 0]
    assert merges and all("FullOuter" in p and "Exchange" not in p and "Sort [" not in p for p in merges)
    # a batch is shuffled by its keys once, whatever it is compared with
    assert any(n > 0 for _, n, _ in seen) and all(p.count("Exchange hashpartitioning(h1#") <= 2 for level, n, p in seen if level == 0)


def test_line_of_many_documents_keeps_its_last(spark):
    rows = [(i, "a line that all documents share\nown %d" % i) for i in range(50)]
    got = {r.doc_id: r.text for r in dedup_lines(frame(spark, rows)).collect()}
    assert got[49].startswith("a line") and all(got[i] == f"own {i}" for i in range(49))


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_match_brute_force(spark, corpus, k):
    want = brute.near(corpus, k)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, corpus), words=k).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_dense_group_of_near_copies(spark):
    """Most pairs are unlinked, though all share bands."""
    r = random.Random(2)
    base = words(r, 120)
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.choice([1, 3, 6, 8])):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want = brute.near(rows, 4)
    got = {x.doc_id: x.component_id for x in near_duplicates(frame(spark, rows), words=4).collect()}
    assert got == {i: c for i, (_, c) in want.items()}


def test_words_of_one_polynomial_hash_are_not_linked(spark):
    """Two words that agree in every polynomial hash modulo a power of two."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, f"x y z {a} u"), (4, f"x y z {b} u"), (5, f"{a} {b}"), (6, f"{b} {a}"), (7, a)]
    got = {x.doc_id: x.component_id for x in near_duplicates(frame(spark, rows), words=4).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 1}


def test_common_shingles_match_sets():
    r = random.Random(12)
    for _ in range(300):
        k = r.choice([1, 2, 4, 5])
        a, b = (" ".join(r.choice("abC") for _ in range(r.randrange(12))) for _ in range(2))
        x, y = brute.shingles(a, k), brute.shingles(b, k)
        assert common_shingles(a.encode(), b.encode(), k) == (len(x), len(y), len(x & y))
    assert common_shingles(None, b"a", 4) == (0, 1, 0)


def test_large_component_with_outliers_is_copied_once(spark):
    """A bucket of 4,000 members of one component and three others."""
    rows = [(7, i, i, 0 if i < 4000 else i) for i in range(4003)]
    out = _paired_blocks(spark.createDataFrame(rows, "key long, m long, f1 long, label long"), F.count("*") / 256)
    assert out.where("label = 0").count() == 4000 and out.count() < 4000 + 3 * 20
    rows = [(7, i, i, i % 3) for i in range(300)]
    out = _paired_blocks(spark.createDataFrame(rows, "key long, m long, f1 long, label long"), F.count("*") / 32).collect()
    met = {}
    for x in out:
        met.setdefault((x.bi, x.bj), []).append((x.block, x.m, x.label))
    pairs = {(p[1], q[1]) for (i, j), v in met.items() for p in v for q in v if p[0] == i and q[0] == j and p[2] != q[2]}
    assert all((a, b) in pairs or (b, a) in pairs for a in range(300) for b in range(a) if a % 3 != b % 3)


def test_rows_with_one_id_are_linked(spark):
    rows = [(2, "alpha beta gamma delta epsilon"), (2, "one two three four five"), (1, "one two three four five"), (None, "alpha beta gamma delta epsilon"), (None, None)]
    got = near_duplicates(frame(spark, rows), words=4).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(2, None), (1, None), (None, None)}


def test_sketches_estimate_similarity_and_fill():
    r = np.random.default_rng(0)
    x = np.unique(r.integers(0, 2**63, 1000, dtype=np.uint64))
    s = sketches([x[:900], x[100:], x[:1], x[:3]], 256)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.1 and (s != np.uint64(2**64 - 1)).all()
    assert 60 < least_agreement(128, 80) < 85


@pytest.mark.parametrize("small", [10**6, 0])
def test_components(spark, small, monkeypatch, tmp_path):
    import ridgeline.llm.components as c

    monkeypatch.setattr(c, "SMALL", small)
    links = [(i + 1, i) for i in range(0, 20)] + [(40, 50), (50, 45), (45, 40), (60, 60)]
    got = {r.node: r.label for r in components(spark, spark.createDataFrame(links, "a long, b long"), f"file://{tmp_path}/c").collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 45: 40, 50: 40}


def test_contamination_matches_brute_force(spark):
    r = random.Random(3)
    items = [(i, " ".join(words(r, n, 60))) for i, n in enumerate([40, 20, 13, 12, 5, 2, 1])] + [(7, None), (8, "!!"), (9, "É ünï " * 8)]
    texts = [" ".join(words(r, 80, 60)) for _ in range(40)]
    for n, (_, t) in enumerate(items[:6]):
        texts[n] = texts[n] + " ... " + t.upper().replace(" ", ", ") + " " + texts[n]
    docs = [*enumerate(texts), (40, None), (41, ""), (42, items[0][1]), (42, "other text"), (None, items[1][1]), (43, items[9][1] * 3)]
    out = contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    key = lambda x: (-1 if x[0] is None else x[0], *map(str, x[1:]))
    want = sorted(brute.contamination(docs, items), key=key)
    assert sorted(((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in out.collect()), key=key) == want
    shuffled = contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=0)
    assert sorted(((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in shuffled.collect()), key=key) == want
    kept = decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    bad = {d for d, n, h, _ in want if h and 20 * h >= n}
    assert {x.doc_id for x in kept.collect()} == {d for d, _ in docs} - bad


def test_window_of_many_items(spark):
    """One word is an item 500 times over; a document has it 300 times."""
    items = spark.createDataFrame([(i, "common") for i in range(500)] + [(999, "rare thing")], "item_id long, text string")
    docs = [(1, "common " * 300), (2, "x common y"), (3, "rare common thing"), (4, "rare thing " + "z " * 60000)]
    got = {x.doc_id: (x.n_words, x.n_hit, len(x["items"]), x.contaminated) for x in contamination(frame(spark, docs), items).collect()}
    assert got == {1: (300, 300, 500, True), 2: (3, 1, 500, True), 3: (3, 1, 500, True), 4: (60002, 2, 1, False)}


def test_personal_data_matches_brute_force(spark, folder, tmp_path):
    r = random.Random(4)
    texts = ["".join(r.choice("ab.@1234567890 -()+.%_éß😀,\n") for _ in range(r.randrange(100))) for _ in range(300)]
    texts += ["4111 1111 1111 1111 x 1 a@b.c_d@e.f 300.1.1.1.5 1.2.3.4.5.6.7.8 +1 (2)3456789012--", "1 " * 20000, "a@b." * 500, "+1" + " 2" * 9000, None, ""]
    texts.append("mail john.doe (at) example (dot) com or call 555-123-4567")
    rows = list(enumerate(texts)) + [(0, texts[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op3_pii(spark, str(tmp_path)).collect(), key=lambda x: x.doc_id)
    for (_, t), x in zip(sorted(rows, key=lambda z: z[0]), got):
        want = brute.base_spans(t)
        listed = ",".join(f"{n}:{a}:{b}" for a, _, b, n in want)
        assert x.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(y[1] == k for y in want) for k in range(4)]
        assert set(filter(None, listed.split(","))) <= set(x.spans.split(","))
    assert got[-1].spans == "email:5:36,phone:45:57"
    red = pii.redact(frame(spark, [(1, "to x@y.zz from 1.2.3.4"), (2, None)], False)).orderBy("doc_id").collect()
    assert [x.redacted for x in red] == ["to [email] from [ip]", ""]


def planted(r, kind, yes):
    """A span of a kind, or something like it, with words around it."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: r.choice(("anna", "bob", "carla", "dmitri", "eve", "fatou")) + r.choice(("", ".k", "_x", "7"))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    tok = lambda some, n: "".join(r.choice(some) for _ in range(n))
    if kind == "email":
        v = f"{name()}{r.choice((' (at) ', '[at]', ' at '))}{{}}" if yes else "{}"
        host = r.choice(("mail", "example", "post7", "uni-x"))
        dot = " dot " if " at " in v else r.choice((" (dot) ", "[dot]"))
        return ("see ", v.format(f"{host}{dot}{r.choice(('com', 'org', 'net'))}") if yes else f"the crowd at {r.choice(('noon', 'home', 'work'))}. then we left")
    if kind == "ip":
        return "from ", ":".join(f"{r.randrange(256, 1 << 16):x}" for _ in range(8)) if yes else ":".join(d(2) for _ in range(8))
    if kind == "card":
        x = d(15)
        total = sum((2 * c - 9 if c > 4 else 2 * c) if j % 2 == 0 else c for j, c in enumerate(map(int, reversed(x))))
        x += str((10 - total % 10 + (0 if yes else r.randint(1, 9))) % 10)
        return r.choice(("paid with ", "it was ")), r.choice("./_").join(x[j : j + 4] for j in range(0, 16, 4))
    if kind == "phone":
        a, b = (r.choice("23456789" if yes else "01") + d(2) for _ in range(2))
        return r.choice(("ring us on ", "phone ", "it is ")) if yes else "order no. ", f"{a}-{b}-{d(4)}" if yes else f"{a}.{b} {d(4)}"
    if yes:
        return r.choice(('token = "', "api key: ", "secret=", "password ")), r.choice((tok("0123456789abcdef", 40), tok(letters, 32), tok(letters, 24)))
    return "we saw ", f"{name()}-story-{d(2)}-about-{name()}"


def test_recall_and_precision_of_added_spans(spark):
    """At least nine in ten planted spans are found, and nine in ten found ones planted."""
    r = random.Random(77)
    docs, truth = [], {}
    for i in range(1500):
        kind, yes = pii.ALL_KINDS[i % 5], i % 2 == 0
        before, v = planted(r, kind, yes)
        text = " ".join(words(r, 12)) + " " + before + v + " " + " ".join(words(r, 12))
        docs.append((i, text))
        at = text.index(v)
        truth[i] = (kind, at, at + len(v)) if yes else None
    got = {x.doc_id: [(pii.ALL_KINDS[s.k], s.s, s.e) for s in x.spans] for x in pii.find_spans(frame(spark, docs, False)).collect()}
    for kind in pii.ALL_KINDS:
        own = [i for i in truth if pii.ALL_KINDS[i % 5] == kind]
        want = [i for i in own if truth[i]]
        right = sum(any(s[0] == kind and s[1] < truth[i][2] and truth[i][1] < s[2] for s in got[i]) for i in want)
        wrong = sum(bool(got[i]) for i in own if not truth[i])
        assert right >= 0.9 * len(want) and right >= 0.9 * (right + wrong), (kind, right, len(want), wrong)


def test_spans_of_a_crowded_text_take_little_time(spark):
    import time

    text = "".join(f"a{i}@b.cc 10.0.{i % 250}.{i % 199} 555-223-{i % 10000:04d} at x.com " for i in range(20000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begun = time.perf_counter()
    x = pii.redact(pii.find_spans(df)).selectExpr("size(base) AS b", "size(spans) AS s", "redacted").first()
    assert time.perf_counter() - begun < 40
    assert x.b == 40000 == len(brute.base_spans(text)) and x.s >= 60000 and x.redacted.count("[email]") >= 20000


def test_columns_of_the_table_stay(spark):
    df = spark.createDataFrame([("mine", "mail x@y.zz", 1, 2, 3)], "text string, body string, m int, more int, scored int")
    x = pii.redact(pii.find_spans(df, "body"), "body").first()
    assert (x.text, x.body, x.m, x.more, x.scored, x.redacted) == ("mine", "mail x@y.zz", 1, 2, 3, "mail [email]")


def test_hints_miss_no_text_of_their_generators():
    r, n = random.Random(46), 0
    parts = ["john", "jane.roe", "x-1", "com", "9", " ", " ", "  ", " at ", "(at)", "[at]", "{at}", " (dot) ", "[dot]", "{dot}", " dot ", ".", ". "] + ["1:", "ab:", "2001:"] + ["abcdefgh1", "0f0f0f0f0f0f0f0f", "x_y-z/9"]
    texts = ["john at example (dot) com", "jane.roe at example[dot]org", "john at  example. com"] + ["".join(r.choices(parts, k=9)) for _ in range(30000)]
    for kind, hint in pii._HINTS.items():
        for t in texts:
            if re.search(pii.GENERATORS[kind], t):
                n += 1
                assert re.search(hint, t), t
    assert n > 1000


def test_passages_are_found_and_clean_documents_left(spark):
    r = random.Random(6)
    a, b = words(r, 60, 10**6), words(r, 70, 10**6)
    fuzzy = list(b)
    fuzzy[20], fuzzy[48:49] = "zz", ["y1", "y2"]
    docs = [(i, " ".join(words(r, 100, 10**6))) for i in range(20)]
    put = lambda i, w: docs.__setitem__(i, (i, docs[i][1] + " " + " ".join(w) + " " + " ".join(words(r, 40, 10**6))))
    for i in (2, 3, 4):
        put(i, a)
    put(5, b)
    put(6, fuzzy)
    docs += [(20, None), (21, ""), (22, "short"), (None, docs[2][1])]
    got = repeated_passages(frame(spark, docs)).collect()
    assert {x.doc_id for x in got} == {None, 2, 3, 4, 5, 6}
    by = {x.doc_id: x for x in got}
    assert (by[3].begin, by[3].end) == (100, 160) and by[5].begin == 100 and by[5].end == 170 and by[6].n_words == 71


def test_passages_are_found_beside_short_excerpts(spark):
    """Two documents share a passage; smaller ids have 8 to 19 words of it each."""
    r = random.Random(16)
    noise = lambda n: words(r, n, 10**6)
    passage = noise(70)
    parts = [passage[at : at + 19] for at in range(52)] + [part for n in range(8, 20) for part in (passage[:n], passage[-n:]) for _ in range(2)]
    docs = [(i, " ".join(noise(60) + part + noise(60))) for i, part in enumerate(parts)]
    docs += [(100, " ".join(noise(30) + passage + noise(30))), (101, " ".join(noise(50) + passage + noise(30)))]
    got = sorted((x.doc_id, x.begin, x.end, x.other_id) for x in repeated_passages(frame(spark, docs)).collect())
    assert got == [(100, 30, 100, 101), (101, 50, 120, 100)]


def test_fuzzy_passages_are_found(spark):
    """Pairs of documents share 60 to 80 words, one in ten of them changed."""
    r, docs, spans = random.Random(26), [], {}
    noise = lambda n: words(r, n, 10**6)
    for i in range(0, 200, 2):
        n = r.randrange(60, 81)
        passage = noise(n)
        other = list(passage)
        for at in r.sample(range(3, n - 3), n // 10):
            other[at] = "changed"
        docs += [(i, " ".join(noise(40) + passage + noise(40))), (i + 1, " ".join(noise(60) + other + noise(20)))]
        spans |= {i: (40, 40 + n), i + 1: (60, 60 + n)}
    got = repeated_passages(frame(spark, docs)).collect()
    assert all(spans[x.doc_id][0] <= x.begin and x.end <= spans[x.doc_id][1] for x in got)
    assert len(got) >= 196


def test_passages_are_found_at_every_place(spark):
    """Three places in the first document, two in the second, one in a third."""
    r = random.Random(36)
    noise = lambda n: words(r, n, 10**6)
    p, own = noise(60), noise(60)
    docs = [(1, p + noise(40) + p + noise(30) + p), (2, noise(20) + p + noise(80) + p), (3, noise(10) + p), (4, own + noise(40) + own), (5, ["a"] * 300), (6, noise(10) + ["a"] * 100)]
    got = repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in docs])).collect()
    assert sorted((x.doc_id, x.begin, x.end, x.other_id) for x in got) == [
        (1, 0, 60, 2), (1, 100, 160, 2), (1, 190, 250, 2), (2, 20, 80, 1), (2, 160, 220, 1), (3, 10, 70, 1), (5, 0, 300, 6), (6, 10, 110, 5),
    ]


def test_passages_against_brute_force(spark):
    """Every word in 51 or more words in a row that another document has too is
    in a passage, and nearly every word of a passage in such a run."""
    docs = [(x.doc_id, x.text) for x in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    want = brute.repeats(docs)
    got = {}
    for x in repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(x.doc_id, set()).update(range(x.begin, x.end))
    n = sum(map(len, want.values()))
    hit = sum(len(w & got.get(i, set())) for i, w in want.items())
    assert n > 1000 and hit >= 0.999 * n
    # what is not an exact run is fuzzy: most of its words are in shared runs of five
    loose = brute.repeats(docs, 5)
    extra = {i: w - want.get(i, set()) for i, w in got.items()}
    assert sum(len(w & loose.get(i, set())) for i, w in extra.items()) >= 0.8 * sum(map(len, extra.values()))


def test_rows_of_one_id_count_as_one_document(spark):
    r = random.Random(46)
    a, b, c = (" ".join(words(r, 70, 10**6)) for _ in range(3))
    rows = [(1, a), (1, b), (2, b), (3, a), (4, c), (4, c), (5, None), (5, c)]
    df = frame(spark, rows)
    first = {x.doc_id: x.text for x in df.where("doc_id in (1, 5)").orderBy(F.xxhash64("text").desc()).collect()}
    got = {(x.doc_id, x.other_id) for x in repeated_passages(df).collect()}
    assert got == ({(1, 3), (3, 1)} if first[1] == a else {(1, 2), (2, 1)}) | ({(4, 5), (5, 4)} if first[5] == c else set())


def test_chains_and_alignment():
    a, b = [0, 10, 20, 30, 40, 50], [100, 110, 5, 130, 15, 150]
    best = chain(a, b)[0]
    assert [a[i] for i in best] == [0, 10, 30, 50]
    assert edits(np.array([1, 2, 3, 4]), np.array([1, 3, 4, 5])) == 2
    x, y = np.arange(100), np.concatenate([np.arange(500, 510), np.arange(20, 80)])
    assert align(x, y, [40, 50], [30, 40], 8, 0.8) == [(20, 80, 10, 70)]


def test_byte_pairs_match_the_library():
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    own, lib = bpe.BytePairs(ranks, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    alphabet = " \t\n\r\x0b\x1c\x85\xa0 aeiou'stdABé漢字ßİ😀123.,;|$%_-  ́"
    texts = ["", "ab" * 3000, "".join(r.choice("abcdefgh") for _ in range(5000)), "\n" * 999, "<|endoftext|>"]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(800)]
    for t in texts:
        ids = own.encode(t)
        assert list(memoryview(ids).cast("I")) == lib.encode_ordinary(t) and own.decode(ids) == t.encode()


def test_byte_bpe_query(spark, folder):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = {x.doc_id: x for x in op6_byte_bpe(spark, folder).collect()}
    for d in table(spark, folder, "documents").collect():
        ids = lib.encode_ordinary(d.text or "")
        assert got[d.doc_id].n_tokens == len(ids) and got[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
    edge = bpe.decode(bpe.encode(frame(spark, [(1, None), (2, ""), (2, "x")]), RANKS, PATTERN), RANKS, PATTERN).collect()
    assert [bytes(x.decoded) for x in edge] == [b"", b"", b"x"] and edge[0].key == "own key"


def test_marginals_match_enumeration():
    r = np.random.default_rng(1)
    trans, start = r.normal(size=(2, 2)), 0.3
    lengths = np.array([5, 0, 3])
    emit = r.normal(size=8)
    p = toxicity.marginals(emit, lengths, trans, start)
    for a, n in ((0, 5), (5, 3)):
        total, ones = 0.0, np.zeros(n)
        for s in itertools.product((0, 1), repeat=n):
            v = np.exp(start * s[0] + sum(emit[a + i] * s[i] for i in range(n)) + sum(trans[s[i], s[i + 1]] for i in range(n - 1)))
            total += v
            ones += v * np.array(s)
        assert np.allclose(p[a : a + n], ones / total)


def test_toxicity_learns_and_rejects(spark):
    r = random.Random(8)
    docs, labels = [], []
    for i in range(600):
        w, bad = words(r, 40), i % 5 == 0
        if bad:
            for v in r.sample(["vile", "scumbag", "nasty", "hateful"], 3):
                w.insert(r.randrange(len(w)), v)
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs += [(600, None), (601, ""), (602, "word " * 20000), (602, "vile nasty hateful scumbag")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark, docs), lab)
    got = toxicity.score(frame(spark, docs), model, spans=True).collect()
    held = [x for x in got if x.doc_id < 600 and zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    right = sum((x.score >= 0.7) == (x.doc_id % 5 == 0) for x in held)
    assert right / len(held) > 0.95 and all(0 <= x.score <= 1 for x in got)
    last = {x.doc_id: x for x in got if x.doc_id >= 600}
    assert last[600].score == last[601].score < 0.5
    some = next(x for x in got if x.doc_id == 5)
    assert some.toxic_spans and all(docs[5][1][s.start : s.end] in ("vile", "scumbag", "nasty", "hateful") for s in some.toxic_spans)
    # a labelled text of 13 MB, wherever it stands, takes nothing from the others
    long = [(i, 1, i % 2) for i in range(700, 712)]
    more = frame(spark, docs + [(i, None) for i, _, _ in long]).withColumn("text", F.when(F.col("doc_id") >= 700, F.repeat(F.lit("plain words here "), 800_000)).otherwise(F.col("text")))
    taught = toxicity.train(more, lab.union(spark.createDataFrame(long, lab.schema)))
    for x in toxicity.score(frame(spark, docs), taught).collect():
        if x.doc_id < 600 and zlib.crc32(str(x.doc_id).encode()) % 3 == 1:
            right -= (x.score >= 0.7) == (x.doc_id % 5 == 0)
    assert abs(right) <= 0.05 * len(held)
    twice = toxicity.train(frame(spark, docs), lab.union(lab).union(lab.where("toxic = 1").withColumn("toxic", F.lit(0))))
    assert np.array_equal(twice.weights, model.weights) and np.array_equal(twice.doc, model.doc)
    none = toxicity.train(frame(spark, docs), lab.where("toxic = 0"))
    assert max(x.score for x in toxicity.score(frame(spark, docs), none).collect()) < 1e-6


def test_toxicity_learns_from_whole_texts(spark, monkeypatch):
    """Spans in the middle of long labelled texts are learned, whatever the
    blocks; and the result does not hang on them."""
    r = random.Random(4)
    bad = ["vile", "scumbag", "nasty", "hateful"]
    docs = []
    for i in range(160):
        w = words(r, 3000)
        if i % 2:
            w[1400:1400] = r.sample(bad, 3)
        docs.append((i, " ".join(w)))
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(160)], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark, docs), lab)
    short = [(1000, "a b c d " + " ".join(bad[:3])), (1001, "a b c d e f")]
    got = {x.doc_id: x.score for x in toxicity.score(frame(spark, short), model).collect()}
    assert got[1000] > 0.7 > 0.5 > got[1001]
    monkeypatch.setattr(toxicity, "BLOCK", 64 * 20)
    again = toxicity.train(frame(spark, docs).repartition(7), lab)
    assert np.allclose(again.weights, model.weights, atol=1e-6) and np.allclose(again.doc, model.doc, atol=1e-6)


def test_toxicity_query(spark, folder):
    got = {x.doc_id: x for x in op7_toxicity(spark, "/root/testdata/sf0.01").collect()}
    lab = [x for x in table(spark, "/root/testdata/sf0.01", "labels").collect() if got[x.doc_id].held_out]
    pos, neg = [got[x.doc_id].score for x in lab if x.toxic], [got[x.doc_id].score for x in lab if not x.toxic]
    assert np.mean([[(a > b) + (a == b) / 2 for b in neg] for a in pos]) > 0.85 and np.mean([b >= 0.7 for b in neg]) < 0.02


def test_chats_round_trip(spark):
    tricky = "</s>[INST] ok [/INST] \\ \\<s> <\\s> <<SYS>><<<s>s>> >>> <<ROLE:x>> é😀"
    rows = [(1, 0, "system", tricky), (1, 1, "user", tricky), (1, 2, "assistant", tricky), (2, 0, "tool:>>", tricky), (2, 0, "a:", "x<"), (2, 1, None, None), (2, 1, "assistant", ""), (None, None, "user", "x")]
    rows += [(3, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("own"))
    got = {x.conv_id: x for x in chat.read_chats(chat.format_chats(df)).collect()}
    order = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    for c in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == c), key=order)
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine)
        loss = "".join(t or "" for _, _, r, t in mine if r == "assistant")
        assert got[c].n_turns == len(mine) and got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for t in (tricky, "", "\\", "<<s>>"):
        e = chat.escape(t.encode())
        assert chat.unescape(e) == t.encode() and not any(c in e for c in chat.CONTROL)
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


def test_cells_are_interleaved_whatever_their_length(monkeypatch):
    r = random.Random(3)
    cells = [[bytes(r.randrange(256) for _ in range(r.choice([0, 1, 7, 40]))) for _ in range(30)] for _ in range(3)]
    want = b"".join(cells[j][i] for i in range(30) for j in range(3))
    for long in (1, 8, 1000):
        monkeypatch.setattr(chat, "LONG", long)
        data, at = chat.assemble(cells)
        assert data.tobytes() == want and at[-1] == len(want)


def test_long_turns(spark):
    text = "</s>long <s> words " * 40000
    got = chat.read_chats(chat.format_chats(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string"))).first()
    assert got.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and got.loss_chars == len(text)


def test_other_tokenizers_go_through_their_whole_pipeline():
    import json

    from tokenizers import Tokenizer

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        described = json.load(f)
    assert rans.ChunkTokenizer(json.dumps(described)).chunked
    described["normalizer"] = {"type": "NFC"}
    own, lib = rans.ChunkTokenizer(json.dumps(described)), Tokenizer.from_str(json.dumps(described))
    texts = ["Some Words, and MORE.", "", "É x  y"]
    assert not own.chunked
    assert [list(memoryview(x).cast(own.code)) for x in own.encode([t.encode() for t in texts], 1)] == [lib.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_token_files_of_odd_tables(spark, tmp_path):
    """Empty, null ids, and a document much longer than a block."""
    schema = "doc_id long, text string, shard string, ids string"
    rans.write_ids(spark.createDataFrame([], schema), f"file://{tmp_path}/a", P.path("word_bpe_49k.json"), 1)
    assert rans.read_ids(spark, f"file://{tmp_path}/a").count() == 0
    rows = [(None, "x", "s", "i"), (2, "long words " * (rans.BLOCK // 2 + 1000), "s", "i"), (3, "end", "s", "i")]
    rans.write_ids(spark.createDataFrame(rows, schema), f"file://{tmp_path}/b", P.path("word_bpe_49k.json"), 1)
    got = sorted(((x.start, x.doc_id, x.n_tokens) for x in rans.read_ids(spark, f"file://{tmp_path}/b").collect()))
    assert [x[1] for x in got] == [None, 2, 3] and got[0][0] == 0 and got[2][0] == got[0][2] + got[1][2] > rans.BLOCK


def test_queries_match_their_sql(spark, folder):
    """SQL of the queries that have one, in another engine."""
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, folder), con.sql(sql)
        assert set(want.columns) == set(got.columns), name
        assert sorted(map(str, (tuple(x[c] for c in want.columns) for x in got.collect()))) == sorted(map(str, want.fetchall())), name


def test_verdicts_of_the_base_match_plain_rules(spark, corpus):
    got = {x.doc_id: x for x in quality.judge(frame(spark, corpus)).collect()}
    for i, t in corpus:
        n, _, _, _, rep = brute.statistics(t)
        assert got[i].base_failed == (n < 50 or 100 * rep > 50 * n) and got[i].kept == (not got[i].base_failed and got[i].quality >= 0.5)


def test_results_are_released(spark, corpus):
    import glob

    from ridgeline.llm import common

    common.release(spark)
    base = common.work_dir(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    before = set(glob.glob(f"{base}/ridgeline-*"))
    out = [near_duplicates(frame(spark, corpus[:20])), repeated_passages(frame(spark, corpus[:20])), dedup_lines(frame(spark, corpus[:20])), contamination(frame(spark, corpus[:20]), spark.createDataFrame([(1, "a b")], "item_id long, text string"))]
    assert all(x.count() >= 0 for x in out) and 0 < len(set(glob.glob(f"{base}/ridgeline-*")) - before) <= 4
    common.release(spark)
    assert not set(glob.glob(f"{base}/ridgeline-*")) - before


def test_blocks_round_trip_and_notice_damage():
    r = np.random.default_rng(0)
    coder = rans.Coder(rans.frequencies(np.bincount(r.geometric(0.01, 10**5), minlength=3000)))
    for n in (0, 1, rans.LANES, rans.LANES + 1, rans.LANES * rans.STRIDE + 1, 300_000):
        ids = np.minimum(r.geometric(0.01, n), 2999)
        block = coder.encode([7, -3], [n // 2, n - n // 2], ids)
        docs, sizes, back = coder.decode(block)
        assert docs.tolist() == [7, -3] and sizes.tolist() == [n // 2, n - n // 2] and (back == ids).all()
    with pytest.raises(ValueError, match="checksum"):
        coder.decode(block[:500] + bytes([block[500] ^ 1]) + block[501:])
    assert rans.frequencies(np.zeros(10, np.int64)).sum() == 1 << rans.SCALE


def test_token_files_query(spark, folder, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    lib.encode_special_tokens = True
    rows = [(d.doc_id, d.text) for d in table(spark, folder, "documents").collect()] + [(10**6, None), (10**6 + 1, ""), (-5, "J̌ İs ÀÉ <|endoftext|> a'll Σς, x.y"), (10**6 + 2, "dup"), (10**6 + 2, "dup")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op9_token_files(spark, f"file://{tmp_path}").collect(), key=lambda x: (x.doc_id, x.start))
    at = 0
    for (i, t), x in zip(sorted(rows, key=lambda z: z[0]), got, strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        assert (x.doc_id, x.start, x.n_tokens, x.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_quality_statistics_and_verdicts(spark, corpus, folder):
    rows = [*corpus, (90, "a b c a b c a b c\na b c a b c a b c\n\n x # | $"), (None, "z")]
    got = quality.judge(frame(spark, rows)).collect()
    key = lambda x: (-1 if x[0] is None else x[0], x[1:])
    want = sorted(((i, *brute.statistics(t)) for i, t in rows), key=key)
    assert sorted(((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in got), key=key) == want
    q = {x.doc_id: x for x in op10_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    lab = table(spark, "/root/testdata/sf0.01", "labels").collect()
    ok = [q[x.doc_id].kept == bool(x.quality) for x in lab if not q[x.doc_id].base_failed]
    assert np.mean(ok) > 0.9 and not any(x.kept for x in q.values() if x.base_failed)
    model = quality.fit([((1, 1, 0), 700), ((1, -1, 0), 50), ((-1, -1, -1), 250)])
    assert model.weights[0][1] > 0 > model.weights[0][-1]


def test_windows_of_one_hash_are_told_apart_by_words(spark, corpus, monkeypatch):
    monkeypatch.setattr(quality, "WINDOW", "h[i] * 0")
    rows = [(i, t) for i, t in corpus if len(t or "") < 9000] + [(90, "a b c a b c x y a b c"), (91, "p q r s p q r p q"), (92, "z z z z")]
    got = sorted((x.id, x.n_repeat_words) for x in quality.statistics(frame(spark, rows)).collect())
    assert got == sorted((i, brute.statistics(t)[4]) for i, t in rows) and any(n for _, n in got)


def test_empty_tables(spark):
    none = frame(spark, []).drop("n_lines", "score", "ids")
    items = spark.createDataFrame([], "item_id long, text string")
    assert dedup_lines(none).count() == near_duplicates(none).count() == repeated_passages(none).count() == contamination(none, items).count() == 0
    assert pii.find_spans(none).count() == quality.judge(none).count() == bpe.encode(none, RANKS, PATTERN).count() == 0
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(none, toxicity.train(none, lab)).count() == 0
    some = frame(spark, [(1, "text")])
    assert [x.contaminated for x in contamination(some, items).collect()] == [False]
