"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``; extra columns of the input stay until
then.

Defined results: null and empty texts are kept, as they are neither toxic nor
copies nor contaminated, and have no ids; a null id is one document before all
others; rows that share an id stay or go together, and go if one is toxic; of near copies the smallest
id stays; without labels of both kinds nothing is toxic; an empty table gives
an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import bpe, toxicity
from ridgeline.llm.common import drop, id_key, keep, made, release, spool, table, work_dir
from ridgeline.llm.decontam import decontaminate
from ridgeline.llm.line_dedup import dedup_lines
from ridgeline.llm.minhash import near_duplicates

#: Documents that score at least this go.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score too high go, and with them all rows of their id."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    keep(root := work_dir(spark, "toxic"))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])  # a column may be called score
    scored = spool(toxicity.score(docs.select("text", rest.alias("rest"), id_key("doc_id").alias("__id")), model), f"{root}/scored")
    toxic = F.col("score") >= TOXIC
    mixed = scored.groupBy("__id").agg(F.bool_or(toxic).alias("some"), F.bool_and(toxic).alias("all")).where("some AND NOT all")
    mixed = spool(mixed.select("__id"), f"{root}/mixed")  # ids of several rows only; joined by its size
    return scored.where(~toxic).join(mixed, "__id", "left_anti").select(*[F.col("text" if c == "text" else f"rest.`{c}`").alias(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs, min_docs=3, min_chars=20)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    groups = near_duplicates(docs, words=5, percent=80)
    kept = groups.where("kept").select(id_key("doc_id").alias("__kept")).distinct()
    return docs.withColumn("__kept", id_key("doc_id")).join(kept.hint("merge"), "__kept", "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    return out.select(
        "doc_id", "lang", "source", "n_chars", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode_tokens),
]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs, last = table(spark, sf_dir, "documents"), None
    root, before = work_dir(spark, "pipeline"), made()
    for i, (name, stage) in enumerate(STAGES):
        path = f"{root}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, before)
        if last:
            drop(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
