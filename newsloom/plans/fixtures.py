"""Content-model views over the driver tables, as SQL that Spark and DuckDB both run.

An item's title is the first line of its document, cut at 500 characters as every
source parser does; its summary is the whole document.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from newsloom.session import spread

AS_OF = "2024-01-31 00:00:00"
BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Tables with long texts, and the key to spread a small scan by.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}

VIEWS: dict[str, str] = {
    "v_tasks": """
SELECT source AS task_id, 'Source ' || source AS name,
 CASE WHEN CAST(substring(source, 4) AS INT) % 5 = 4 THEN 'paused' ELSE 'active' END AS status,
 CASE WHEN CAST(substring(source, 4) AS INT) % 7 = 6 THEN 'catalog' ELSE 'discussion' END AS content_kind,
 CASE WHEN CAST(substring(source, 4) AS INT) % 6 = 5 THEN NULL ELSE 'https://' || source || '.example.com/' END AS source_url,
 CASE WHEN CAST(substring(source, 4) AS INT) % 9 = 8 THEN TIMESTAMP '2023-12-20 00:00:00' END AS deleted_at
FROM (SELECT DISTINCT source FROM documents) d""",
    "v_items": """
SELECT d.doc_id AS item_id, d.source AS task_id,
 substring(split_part(d.text, chr(10), 1), 1, 500) AS title,
 d.text AS summary,
 'https://' || d.source || '.example.com/' || CAST(d.doc_id % 900 AS STRING) AS url,
 CASE WHEN d.doc_id % 4 = 0 THEN 'x' || CAST(d.doc_id % 50 AS STRING) END AS external_id,
 d.doc_id % 3 = 0 AS is_read, d.doc_id % 11 = 0 AS is_starred,
 e.ts AS fetched_at, e.ts AS created_at
FROM (SELECT doc_id, source, text, doc_id * CAST(floor((SELECT count(*) FROM events) / (SELECT count(*) FROM documents)) AS BIGINT) AS at_event
 FROM documents) d JOIN events e ON e.event_id = d.at_event""",
    # Titles of every other item with their accents as marks of their own.
    "v_items_mixed": """
SELECT item_id, task_id, CASE WHEN item_id % 2 = 0 THEN replace(replace(replace(replace(title, 'é', 'e\u0301'), 'ü', 'u\u0308'), 'ó', 'o\u0301'), 'ö', 'o\u0308') ELSE title END AS title,
 summary, url, external_id, fetched_at, created_at FROM v_items""",
    # Titles written without blanks, titles that are copies, and items without a time.
    "v_items_odd": """
SELECT item_id, task_id, CASE WHEN item_id % 7 = 3 THEN replace(title, ' ', '') WHEN item_id % 10 = 9 THEN 'Acme 3.1 ships openai/gym' ELSE title END AS title, summary, url, external_id,
 CASE WHEN item_id % 50 <> 7 THEN fetched_at END AS fetched_at, created_at FROM v_items""",
    "v_interactions": """
SELECT event_id AS interaction_id, user_id,
 (event_id * 7) % (SELECT count(*) FROM documents) AS item_id,
 CASE event_type WHEN 'purchase' THEN 'star' WHEN 'signup' THEN 'impression' WHEN 'error' THEN 'not_interested' ELSE event_type END AS interaction_type,
 CASE WHEN event_type IN ('view', 'click') THEN CAST(floor(value) AS INT) END AS dwell_seconds,
 ts AS created_at FROM events""",
    "v_executions": """
SELECT event_id AS execution_id, 'src' || CAST(user_id % 20 AS STRING) AS task_id,
 CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'warning' ELSE 'success' END AS status,
 CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE 1 + event_id % 40 END AS items_fetched,
 CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE least(1 + event_id % 40, (event_id * 3) % 17) END AS items_new,
 CAST(floor(value * 10) AS BIGINT) AS duration_ms,
 CASE WHEN event_type = 'error' THEN
  CASE event_id % 6 WHEN 0 THEN 'HTTP 403 Forbidden' WHEN 1 THEN 'Timeout after 15.0s' WHEN 2 THEN 'SSRF blocked: private address'
   WHEN 3 THEN 'Connection error: refused' WHEN 4 THEN 'Response too large: limit' ELSE 'HTTP 503 Service Unavailable' END END AS error_message,
 ts AS executed_at FROM events""",
    "v_run_events": """
SELECT event_id, 'run' || CAST(user_id % 200 AS STRING) AS execution_id, 'src' || CAST(user_id % 20 AS STRING) AS task_id,
 CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'fetching' WHEN 'signup' THEN 'parsing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS state,
 props, ts AS created_at FROM events""",
    "v_thread_items": """
SELECT 't' || CAST(item_id % 97 AS STRING) AS thread_id, item_id, task_id, title, fetched_at,
 CASE WHEN item_id < 97 THEN 1.0e0 ELSE CAST((item_id * 37) % 100 AS DOUBLE) / 100 END AS similarity,
 CASE WHEN item_id < 97 AND item_id % 2 = 0 THEN 'initial_item' WHEN item_id < 97 THEN 'no_match' ELSE 'score' END AS match_reason
FROM v_items""",
    "v_threads": """
SELECT thread_id, max_by(title, CAST(length(title) AS BIGINT) * 1000000000 - item_id) AS title, min(fetched_at) AS first_seen_at,
 max(fetched_at) AS last_seen_at, count(*) AS item_count FROM v_thread_items GROUP BY thread_id""",
    # More than 500 threads, all of them seen in the last 24 hours.
    "v_live_items": """
SELECT 'r' || CAST(item_id % 509 AS STRING) AS thread_id, item_id, task_id, title,
 (SELECT max(ts) FROM events) - INTERVAL '1' MINUTE * ((item_id * 7) % 1430) AS fetched_at FROM v_items""",
    "v_live_threads": """
SELECT thread_id, max_by(title, CAST(length(title) AS BIGINT) * 1000000000 - item_id) AS title, min(fetched_at) AS first_seen_at,
 max(fetched_at) AS last_seen_at, count(*) AS item_count FROM v_live_items GROUP BY thread_id""",
    "v_relations": """
SELECT least(a, b) AS thread_a, greatest(a, b) AS thread_b, max(s) AS similarity,
 min(src) AS source FROM (SELECT 't' || CAST(item_id % 97 AS STRING) AS a, 't' || CAST((item_id * 31 + 5) % 97 AS STRING) AS b,
  CAST((item_id * 13) % 35 AS DOUBLE) / 100 AS s, CASE WHEN item_id % 10 = 0 THEN 'split' ELSE 'auto' END AS src FROM v_items) x
WHERE a <> b GROUP BY least(a, b), greatest(a, b)""",
    "v_overrides": """
SELECT thread_a AS thread_id, thread_b AS target_thread_id, 'reject_merge' AS override_type
FROM v_relations WHERE CAST(substring(thread_a, 2) AS INT) % 6 = 0""",
    "v_labels": """
SELECT doc_id AS item_id, quality AS label, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST((doc_id * 29) % 101 AS DOUBLE) / 100 END AS sampled_score FROM labels""",
    "v_receipts": """
SELECT u.conv_id * 1000 + u.turn AS receipt_id, 'model-a' AS model, 'be brief' AS system, u.text AS prompt, a.text AS result_text,
 CASE WHEN u.conv_id % 8 = 7 THEN 'failed' ELSE 'done' END AS status,
 CAST(floor(length(u.text) / 4) AS BIGINT) AS input_tokens, CAST(floor(length(a.text) / 4) AS BIGINT) AS output_tokens, e.ts AS created_at
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
JOIN events e ON e.event_id = u.conv_id
WHERE u.role = 'user'""",
    # Interest words: the fixed three of the design plus every language tag in the data.
    "v_topics": """
SELECT lang AS topic, 'language' AS category, 0.5e0 + CAST(count(*) % 7 AS DOUBLE) / 10 AS weight, CAST(count(*) AS BIGINT) AS seq
FROM documents GROUP BY lang
UNION ALL SELECT * FROM (VALUES ('the', 'custom', 1.0e0, CAST(1 AS BIGINT)), ('la', 'custom', 0.5e0, CAST(2 AS BIGINT)), ('der', 'ai', 2.0e0, CAST(3 AS BIGINT))) t(topic, category, weight, seq)""",
}

# Topics of many readers: first words of the titles they starred, and for some a frequent word.
VIEWS["v_reader_topics"] = """
SELECT user_id, topic, 'custom' AS category, 0.5e0 + CAST(max(seq) % 16 AS DOUBLE) / 10 AS weight, max(seq) AS seq
FROM (SELECT n.user_id, split_part(i.title, ' ', 1) AS topic, n.interaction_id AS seq FROM v_interactions n JOIN v_items i ON i.item_id = n.item_id WHERE n.interaction_type = 'star'
 UNION ALL SELECT user_id, 'The' AS topic, min(interaction_id) AS seq FROM v_interactions WHERE user_id % 3 = 0 GROUP BY user_id) x WHERE trim(topic) <> '' GROUP BY user_id, topic"""

# What Spark reads instead, with the same rows: titles are cut before items meet their times, so that a query
# without summaries sends no text to that join.
_TITLE = "substring(split_part({}text, chr(10), 1), 1, 500) AS title,"
SPARK_VIEWS = {"v_items": VIEWS["v_items"].replace(_TITLE.format("d."), "d.title,").replace(
    "SELECT doc_id, source, text,", f"SELECT doc_id, source, text, {_TITLE.format('')}")}

_NAMES = "|".join([*VIEWS, *BASE_TABLES])
_USE = re.compile(rf"\b(FROM|JOIN)\s+({_NAMES})\b", re.IGNORECASE)


def views_used(sql: str) -> list[str]:
    """Fixture views a statement needs, dependencies first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for _, name in _USE.findall(text):
            if name in VIEWS and name not in found:
                visit(VIEWS[name])
                found.append(name)

    visit(sql)
    return found


def with_views(sql: str) -> str:
    """Inline the fixture views a DuckDB statement uses as common table expressions."""
    names = views_used(sql)
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE)
    if head:
        return f"WITH {head.group(1) or ''}{ctes},\n{body[head.end():]}"
    return f"WITH {ctes}\n{body}"


class Tables:
    """Lazy DataFrames for base tables and fixture views, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in {*VIEWS, *BASE_TABLES}:
            raise AttributeError(name)
        if name not in self._cache:
            if name in VIEWS:
                self._cache[name] = self.sql(SPARK_VIEWS.get(name, VIEWS[name]))
            else:
                table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
                self._cache[name] = spread(table, TEXT_TABLES[name]) if name in TEXT_TABLES else table
        return self._cache[name]

    def sql(self, text: str) -> DataFrame:
        """Run Spark SQL whose FROM / JOIN names are base tables or fixture views."""
        used = {n.lower(): getattr(self, n.lower()) for _, n in _USE.findall(text)}
        return self.spark.sql(_USE.sub(lambda m: f"{m[1]} {{{m[2].lower()}}}", text), **used)
