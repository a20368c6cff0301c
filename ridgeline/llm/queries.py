"""The queries opN_<name> over whole tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import bpe, chat, merkle, packing, pii, rans, toxicity, vector_codes
from ridgeline.llm.common import keep, table, work_dir
from ridgeline.llm.decontam import contamination
from ridgeline.llm.line_dedup import dedup_lines
from ridgeline.llm.minhash import near_duplicates
from ridgeline.llm.quality import judge
from ridgeline.llm.substrings import repeated_passages


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, min_docs=3, min_chars=20)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL_OP1 = r"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, line, i,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT a.doc_id, a.line, a.i, coalesce(r.owner <> a.doc_id, false) AS gone
  FROM keyed a LEFT JOIN repeated r ON a.k = r.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, words=4, percent=80)


SQL_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh
  FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT l.a, r.seen FROM reach r JOIN links l ON l.b = r.node
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) c ON s.doc_id = c.node
"""


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda spans, k: F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")
    return out.select(
        "doc_id", *[count("base", i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), count("spans", pii.ALL_KINDS.index("secret")).alias("n_secret"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"), window=13, one_in=20)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


SQL_OP4 = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, size, w FROM (
    SELECT item, least(len(ws), 13) AS size,
      unnest(list_transform(range(1, len(ws) - least(len(ws), 13) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 13) - 1], ' '))) AS w
    FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT d.doc_id, s.size, unnest(range(1, len(ws) - s.size + 2)) AS i,
    unnest(list_transform(range(1, len(ws) - s.size + 2), lambda i: array_to_string(ws[i:i + s.size - 1], ' '))) AS w
  FROM d, (SELECT DISTINCT size FROM bw) s WHERE len(ws) >= s.size
), hit AS (
  SELECT dw.doc_id, dw.i, dw.size, bw.item FROM dw JOIN bw ON dw.w = bw.w AND dw.size = bw.size
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hit)) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text"), path, public_tokenizers.PATTERN)
    return out.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, spans=True)
    return out.select(
        "doc_id", (~toxicity.in_training(F.col("doc_id"))).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("toxic_spans").cast("long").alias("n_spans"),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql(
        "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)"
    )
    return chat.read_chats(chat.format_chats(turns.unionByName(own)))


SQL_OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(replace(text, '\', '\\'),
      '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<<ROLE:|<</ROLE>>|:>>')) AS n,
    CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 15 ELSE 20 + length(role) END AS w
  FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + w) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keep(path := work_dir(spark, "ids"))
    rans.write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return rans.read_ids(spark, path)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).drop("votes")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, size=4096)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes.encode(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


#: One round: every part's nearest entry, then the floors of the means.
_ROUND = """
, a{n} AS MATERIALIZED (
  SELECT r, p, v, least_entry.k AS k, least_entry.d AS d FROM (
    SELECT r, p, any_value(x.v) AS v, min(struct_pack(d := list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), k := c.k)) AS least_entry
    FROM parts x JOIN c{n} c USING (p) GROUP BY r, p)
)"""
_MOVE = """
, c{m} AS MATERIALIZED (
  SELECT c.p, c.k, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (
    SELECT p, k, list(CAST(floor(CAST(s AS DOUBLE) / n) AS HUGEINT) ORDER BY i) AS v FROM (
      SELECT p, k, i, sum(y) AS s, count(*) AS n FROM (SELECT p, k, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY p, k, i)
    GROUP BY p, k) m USING (p, k)
)"""
SQL_OP12 = (
    r"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), wide AS (SELECT CAST(greatest(1, ceil(max(len(q)) / 4)) AS BIGINT) AS w FROM kept), padded AS (
  SELECT r, w, list_concat(q, list_transform(range(4 * w - len(q)), lambda i: 0::HUGEINT)) AS q FROM kept, wide
), parts AS MATERIALIZED (
  SELECT r, p, q[p * w + 1:(p + 1) * w] AS v FROM padded, range(4) t(p)
), c0 AS MATERIALIZED (SELECT p, r - 1 AS k, v FROM parts WHERE r <= 256)"""
    + "".join(_ROUND.format(n=n) + _MOVE.format(n=n, m=n + 1) for n in range(4))
    + _ROUND.format(n=4)
    + r"""
, coded AS (
  SELECT r, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY r
), books AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c4
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), books
"""
)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.leaf_hash(*fields, F.col("text"))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = F.when(even, merkle.leaf_hash(*fields, F.translate("text", "\n", ""))).otherwise(leaf)
    out = merkle.prove(docs.select("doc_id", "source", leaf.alias("leaf"), shown.alias("shown")), more=["shown"])
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    out = out.withColumn("proof_sha256", F.sha2(siblings, 256)).withColumn("folded_root", merkle.folded(F.col("shown"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _crc32_is_even(digits: str) -> str:
    """SQL for the parity of the CRC-32 of ASCII digits."""
    bit = "lambda c, b: xor(c >> 1, (c & 1) * 3988292384)"
    byte = f"lambda c, x: list_reduce(range(8), {bit}, xor(c, x))"
    codes = f"list_transform(range(1, length({digits}) + 1), lambda i: CAST(ascii(substr({digits}, i, 1)) AS BIGINT))"
    return f"(xor(list_reduce({codes}, {byte}, 4294967295), 4294967295) & 1) = 0"


def _field(name: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


_FIELDS = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
SQL_OP13 = rf"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, source, leaf, CASE WHEN doc_id IS NOT NULL AND {_crc32_is_even("CAST(doc_id AS VARCHAR)")} THEN sha256({_FIELDS} || {_field("replace(text, chr(10), '')")}) ELSE leaf END AS shown
  FROM (SELECT *, sha256({_FIELDS} || {_field("text")}) AS leaf FROM documents)
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, shown) - 1 AS i, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER () AS r
  FROM leaves
), low AS (
  SELECT tree, 0 AS level, i, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY tree, level, i // 3
), subroots AS MATERIALIZED (SELECT tree, level AS height, node FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, tree AS i, node, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM high WHERE n > 1 GROUP BY level, i // 3
), nodes AS MATERIALIZED (
  SELECT l.tree, level, i, l.node FROM low l WHERE n > 1
  UNION ALL SELECT s.tree, s.height + h.level, h.i, h.node FROM subroots s, high h WHERE h.n > 1
), walk AS (
  SELECT p.r, p.tree, t AS level, CASE WHEN t < s.height THEN p.i // CAST(pow(3, t) AS BIGINT) ELSE p.tree // CAST(pow(3, t - s.height) AS BIGINT) END AS i
  FROM placed p JOIN subroots s USING (tree), range(60) v(t) WHERE t < s.height + (SELECT max(level) FROM high)
), steps AS MATERIALIZED (
  SELECT w.r, w.level, coalesce(string_agg(x.node, '' ORDER BY x.i) FILTER (WHERE x.i < w.i), '') AS before, coalesce(string_agg(x.node, '' ORDER BY x.i) FILTER (WHERE x.i > w.i), '') AS after
  FROM walk w JOIN nodes x ON x.tree = w.tree AND x.level = w.level AND x.i // 3 = w.i // 3 GROUP BY w.r, w.level
), fold AS (
  SELECT r, 0 AS level, shown AS node FROM placed
  UNION ALL
  SELECT f.r, f.level + 1, sha256(s.before || f.node || s.after) FROM fold f JOIN steps s ON f.r = s.r AND f.level = s.level
), folded AS (SELECT r, arg_max(node, level) AS folded_root FROM fold GROUP BY r),
proofs AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY r)
SELECT p.doc_id, p.leaf, s.node AS subroot, h.node AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = h.node AS verified
FROM placed p JOIN subroots s USING (tree) JOIN folded f USING (r) LEFT JOIN proofs q USING (r), (SELECT node FROM high WHERE n = 1) h
"""


_ALL = (op1_line_dedup, op2_minhash_near_dedup, op3_pii, op4_decontamination, op5_substring_dedup, op6_byte_bpe, op7_toxicity, op8_chat_format, op9_token_files, op10_quality_rules, op11_packing, op12_vector_codes, op13_merkle_manifest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": SQL_OP1, "op2_minhash_near_dedup": SQL_OP2, "op4_decontamination": SQL_OP4, "op8_chat_format": SQL_OP8, "op12_vector_codes": SQL_OP12, "op13_merkle_manifest": SQL_OP13}
