"""Benchmark decontamination with a broadcast set of normalised n-grams.

Every window of 13 benchmark words (all words of a shorter item) is looked for
in every document.  A window of L words holds, wherever it occurs, one whole
gram of q = ceil(L / 2) words that begins at a multiple of L - q + 1, so the
first scan hashes only every (L - q + 1)-th gram of a document and probes the
set of benchmark grams; this finds all documents with a window.  In these, all
windows are hashed and probed, and each hit is verified word by word.

Only DataFrame functions are used.  Documents meet windows, not items: a window
that many items share is one row, and its items come in once per document that
has it.  A table is broadcast when its size, summed over its rows, is within
``BROADCAST_BYTES``; beyond that the joins shuffle, with the same result.

Defined results: null and empty texts have no words and no hits; items without
words are ignored, and without any item no document has a hit; items with the
same id count as one; rows that share an id are judged by their own text, and
repeated rows get equal rows; a text of any length is read whole; item ids are
sorted as text, so ties cannot occur; an empty table gives an empty table.
``docs`` may have any other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import NULL_ID, ascii_lower, id_key, result, spool, work_dir

#: Bytes of a table that may be broadcast, and of a broadcast row without texts.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 96
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Words of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _bounded(df: DataFrame, size: int, most: int) -> DataFrame:
    return F.broadcast(df) if size <= most else df.hint("merge")


def _gram(size: int) -> tuple[int, int]:
    q = (size + 1) // 2
    return q, size - q + 1


def _hashes(words: str, size: int, span: int, step: int) -> Column:
    """Hashes of the ``span``-grams at every ``step``-th word of texts with at
    least ``size`` words."""
    return F.expr(
        f"CASE WHEN size({words}) >= {size} THEN transform(sequence(0, size({words}) - {span}, {step}), "
        f"i -> xxhash64({size}, slice({words}, i + 1, {span}))) ELSE cast(array() AS array<bigint>) END"
    )


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct (item, size, w), w being the words of one window."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), item_words(F.col(f"`{text_col}`")).alias("words"))
    items = items.where("size(words) > 0").withColumn("size", F.least(F.size("words"), F.lit(window)))
    at = F.explode(F.expr("sequence(0, size(words) - size)")).alias("i")
    return items.select("item", "size", "words", at).select("item", "size", F.expr("slice(words, i + 1, size)").alias("w")).distinct()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    one_in: int = 20,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items, contaminated.

    ``n_hit`` counts words inside any occurrence of a window; a document is
    contaminated if it has one and ``one_in * n_hit >= n_words``.
    """
    spark = docs.sparkSession
    root = work_dir(spark, "decontam")
    windows = spool(benchmark_windows(benchmark, item_col, item_text_col, window), f"{root}/windows")
    forms = spool(windows.select("size", "w").distinct().select(F.monotonically_increasing_id().alias("wid"), "size", "w", F.xxhash64("size", "w").alias("h")), f"{root}/forms")
    owners = spool(windows.join(forms, ["size", "w"]).select("wid", "item"), f"{root}/owners")
    # a word of an array takes 16 bytes at most beside its text, of which eight round it up
    width = ROW_BYTES + F.expr("aggregate(w, 0L, (a, x) -> a + 24 + octet_length(x))")
    grouped = forms.groupBy("size").agg(F.count("*").alias("n"), F.sum(width).alias("bytes")).collect()
    sizes = sorted(r["size"] for r in grouped)
    gram_bytes, form_bytes = ROW_BYTES * window * sum(r["n"] for r in grouped), sum(r["bytes"] for r in grouped)
    owner_bytes = owners.agg(F.coalesce(F.sum(ROW_BYTES + F.octet_length("item")), F.lit(0))).first()[0]
    texts = docs.select(id_key(id_col).alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("fp"), F.col(f"`{text_col}`").alias("text"))
    none = F.array().cast("array<bigint>")

    probes = F.concat(none, *[_hashes("words", n, _gram(n)[0], _gram(n)[1]) for n in sizes])
    scanned = texts.select("doc", "fp", item_words(F.col("text")).alias("words"))
    scanned = spool(scanned.select("doc", "fp", F.size("words").cast("long").alias("n_words"), probes.alias("probes")), f"{root}/scan")

    grams = windows.select(
        F.explode(
            F.concat(none, *[F.when(F.col("size") == n, _hashes("w", n, _gram(n)[0], 1)).otherwise(none) for n in sizes])
        ).alias("g")
    ).distinct()
    near = scanned.select("doc", "fp", F.explode("probes").alias("g")).join(_bounded(grams, gram_bytes, broadcast_bytes), "g", "left_semi")
    near = spool(near.select("doc", "fp").distinct(), f"{root}/hit")
    held = texts.join(_bounded(near, ROW_BYTES * near.count(), broadcast_bytes), ["doc", "fp"], "left_semi").dropDuplicates(["doc", "fp"])
    held = spool(held.select("doc", "fp", item_words(F.col("text")).alias("words")), f"{root}/near")

    places = [
        F.expr(
            f"CASE WHEN size(words) >= {n} THEN transform(sequence(0, size(words) - {n}), "
            f"i -> struct(i AS at, xxhash64({n}, slice(words, i + 1, {n})) AS h)) ELSE cast(array() AS array<struct<at:int,h:bigint>>) END"
        )
        for n in sizes
    ]
    places = F.concat(F.array().cast("array<struct<at:int,h:bigint>>"), *places)
    found = held.select("doc", "fp", F.explode(places).alias("p")).select("doc", "fp", "p.at", "p.h").join(_bounded(forms, form_bytes, broadcast_bytes), "h")
    found = found.groupBy("doc", "fp").agg(F.collect_list(F.struct("at", "size", "w", "wid")).alias("found"))
    found = found.join(held, ["doc", "fp"]).select("doc", "fp", F.expr("filter(found, x -> slice(words, x.at + 1, x.size) = x.w)").alias("found"))
    spans = F.expr("array_sort(array_distinct(transform(found, x -> struct(x.at AS at, x.at + x.size AS upto))))")
    covered = F.expr(
        "aggregate(spans, named_struct('n', 0L, 'upto', 0), (a, x) -> named_struct("
        "'n', a.n + greatest(0, x.upto - greatest(x.at, a.upto)), 'upto', greatest(a.upto, x.upto)), a -> a.n)"
    )
    wids = F.expr("array_distinct(transform(found, x -> x.wid))")
    hits = spool(found.withColumn("spans", spans).select("doc", "fp", covered.alias("n_hit"), wids.alias("wids")), f"{root}/hits")
    items = hits.select("doc", "fp", F.explode("wids").alias("wid")).join(_bounded(owners, owner_bytes, broadcast_bytes), "wid")
    items = items.groupBy("doc", "fp").agg(F.array_sort(F.collect_set("item")).alias("items"))

    out = scanned.select("doc", "fp", "n_words").join(hits.select("doc", "fp", "n_hit").join(items, ["doc", "fp"], "left"), ["doc", "fp"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = out.select(
        F.nullif("doc", F.lit(NULL_ID)).alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (one_in * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
    return result(out, root)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that ``contamination`` marks."""
    report = contamination(docs, benchmark, id_col=id_col, **options)
    bad = report.where("contaminated").select(id_key(id_col).alias("__rl_key")).distinct()
    bad = _bounded(bad, ROW_BYTES * bad.count(), options.get("broadcast_bytes", BROADCAST_BYTES))
    return docs.withColumn("__rl_key", id_key(id_col)).join(bad, "__rl_key", "left_anti").drop("__rl_key")
