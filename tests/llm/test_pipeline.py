import random

import numpy as np
import tiktoken

import corpus_pipeline
from ridgeline.llm import bpe, toxicity
from ridgeline.llm.common import table

from . import brute


def test_pipeline_matches_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, folder).collect()}

    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    rows = []
    for d in docs.collect():
        tokens = [(d.text or "").split()]
        if model.scores(tokens, model.token_marginals(tokens))[0] < corpus_pipeline.TOXIC:
            rows.append((d.doc_id, d.text))
    assert 0 < len(rows) < docs.count()
    rows = [(i, t) for i, _, _, t in brute.lines(rows)]
    groups = brute.near(rows, 5)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    items = [(x.item_id, x.text) for x in table(spark, folder, "benchmark").collect()]
    bad = {d for d, n, h, _ in brute.contamination(rows, items) if h and 20 * h >= n}
    rows = [(i, t) for i, t in rows if i not in bad]
    lib = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert set(got) == {i for i, _ in rows} and bad
    for i, t in rows:
        assert bytes(got[i].ids) == np.array(lib.encode_ordinary(t), "<u4").tobytes() and got[i].round_trip and got[i].n_chars == len(t)


def test_stages_keep_the_columns_of_documents(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "minhash_near_dedup", "decontamination", "byte_bpe"]


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, extra columns; and nothing at all."""
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "a", 0), (1, text, "en", "a", 0), (2, None, None, None, None), (3, "", "en", "a", 0), (None, text + " more", "en", None, 1), (4, "z " * 60000, "de", "b", 2), (5, text, "en", "a", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string"
    for name, some in (("full", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame([(*r, "own", "own") for r in some], schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(9, 1, 1)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "plain item text")] if some else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        # a null id comes before all others, so its near copies go
        assert [x.doc_id for x in sorted(got, key=lambda x: x.doc_id or 0)] == ([None, 2, 3, 4] if some else [])
        assert all(x.round_trip for x in got)


def test_rows_of_an_id_go_together(spark, tmp_path):
    r = random.Random(6)
    bad = ["vile", "scumbag", "nasty", "hateful"]
    text = lambda toxic: " ".join([f"w{r.randrange(400)}" for _ in range(40)] + (r.sample(bad, 3) if toxic else []))
    rows = [(i, text(i % 5 == 0)) for i in range(400)] + [(9000, text(False)), (9000, text(True)), (9001, text(False)), (9001, text(False)), (None, text(True)), (None, text(False))]
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, score string")
    got = [(x.doc_id, x.score) for x in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()]
    assert [x for x in got if x[0] is None or x[0] >= 9000] == [(9001, "own")] * 2


def test_stages_find_near_copies_and_keep_the_rest(spark):
    """All pairs of similarity 0.8 or more lose one document; recall is 1 against brute force."""
    r = random.Random(17)
    rows = []
    for i in range(0, 300, 3):
        w = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(60, 200))]
        rows.append((i, " ".join(w)))
        for k in (1, 2):
            v = list(w)
            for at in r.sample(range(len(v)), r.randrange(0, 6)):
                v[at] = f"c{r.randrange(10**6)}"
            rows.append((i + k, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i, (_, c) in brute.near(rows, 5).items() if i == c}
    got = {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert got == want and 100 < len(want) < 300
