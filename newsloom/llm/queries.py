"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import alignment, chat, decontaminate, exact, id_files, minhash, packing, quality, substring
from newsloom.llm import token_counts, toxicity, warc, whitening
from newsloom.llm.common import new_folder, table, written

# The vocabulary files stay where they are installed.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2


def op1_mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), WORD_TOKENIZER, END_ID, with_ids=False)


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.repeated_words(table(spark, folder, "documents"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"))


OP3_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(bare) AS text_sha256
FROM t WINDOW w AS (PARTITION BY bare ORDER BY length(text) DESC, doc_id)
"""


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"), new_folder(spark, "warc"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), BYTE_TOKENIZER, new_folder(spark, "token-cache"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxic_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_id_files(spark: SparkSession, folder: str) -> DataFrame:
    return id_files.id_digests(table(spark, folder, "documents"), new_folder(spark, "ids"), BYTE_TOKENIZER, END_ID)


def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_groups(table(spark, folder, "documents"))


# A conversation whose texts look like the marks of templates.
MARKED = "\\### Assistant: </turn> ok"


def op10_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED).alias("text"))
    return chat.digests(written(chat.windows(rows.unionByName(marked)), "windows"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignments(table(spark, folder, "documents"), BYTE_TOKENIZER, PIECE_TOKENIZER)


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"))


# A window of 20 words is later if another one with its words starts before it.
OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
 g AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i:i + 19], ' ') END AS win FROM p),
 r AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS later FROM g),
 c AS (SELECT *, max(later::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM r),
 k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""

OP5_SQL = """
WITH t AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
 b AS (SELECT *, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS target FROM t)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
 CASE WHEN target = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(target, page_id) AS refers_to FROM b
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
 e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT e.y, reach.r FROM reach JOIN e ON e.x = reach.doc_id),
 m AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

OP10_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{MARKED}' UNION ALL SELECT -7, 1, 'assistant', '{MARKED}'),
 t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
  len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\t-\r \p{{L}}\p{{N}}]')) + {chat.TURN_TOKENS} AS tokens,
  18 + length(replace(replace(role, '\', '\b'), '<', '\l')) + length(replace(replace(text, '\', '\b'), '<', '\l')) AS chars FROM c),
 s AS MATERIALIZED (SELECT *, n = 1 AND role = 'system' AS sys FROM t),
 p AS (SELECT *, coalesce(sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER b, 0) AS before, max(CASE WHEN sys THEN tokens END) OVER (PARTITION BY conv_id) AS kept FROM s
  WINDOW b AS (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 h AS (SELECT *, floor(greatest({chat.BUDGET - chat.HISTORY} - coalesce(kept, 0), 2) / 2) AS half FROM p),
 o AS (SELECT *, tokens > half AND NOT sys AS long FROM h),
 m AS (SELECT *, sum(long::INT) OVER (PARTITION BY conv_id ORDER BY n) AS longs, floor(coalesce(sum(CASE WHEN long OR sys THEN 0 ELSE tokens END) OVER b, 0) / half) AS cell FROM o
  WINDOW b AS (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 f AS (SELECT *, longs || ':' || CASE WHEN long THEN -1 ELSE cell END AS part, min(n) OVER (PARTITION BY conv_id ORDER BY before RANGE BETWEEN {chat.HISTORY} PRECEDING AND CURRENT ROW) AS back FROM m WHERE NOT sys),
 g AS (SELECT *, coalesce((lag(part) OVER (PARTITION BY conv_id ORDER BY n) <> part)::INT, 0) AS changed FROM f),
 v AS (SELECT *, sum(changed) OVER (PARTITION BY conv_id ORDER BY n) AS win FROM g),
 i AS (SELECT conv_id, win, arg_min(back, n) AS low, max(n) AS high FROM v GROUP BY ALL
  UNION ALL SELECT conv_id, 0, 1, 0 FROM s GROUP BY conv_id HAVING bool_and(sys)),
 z AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM i JOIN s USING (conv_id) WHERE sys OR n BETWEEN low AND high GROUP BY conv_id),
 a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS lines,
  coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS loss FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a JOIN z USING (conv_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixture_packing": op1_mixture_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_arc_to_warc": op5_arc_to_warc,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_id_files": op8_id_files,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_chat_windows": op10_chat_windows,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_token_alignment": op12_token_alignment,
    "op13_quality_rules": op13_quality_rules,
}
CHECKS: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op5_arc_to_warc": OP5_SQL,
    "op9_minhash_near_dedup": OP9_SQL,
    "op10_chat_windows": OP10_SQL,
}
