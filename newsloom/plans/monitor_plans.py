"""Queries over search, dashboards, run monitoring and the model-call ledger."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import dashboard, ledger, monitor, search
from newsloom.plans.fixtures import AS_OF, Tables
from newsloom.plans.registry import query
from newsloom.session import shared_folder

NOW = f"TIMESTAMP '{AS_OF}'"
# A day with data, for the "today" figures.
TODAY = "2024-01-30 23:59:59"


# Search -------------------------------------------------------------------------------

@query("q01_item_page", check="""WITH f AS (SELECT * FROM v_items WHERE NOT is_read AND created_at >= TIMESTAMP '2024-01-08 00:00:00')
SELECT f.item_id, f.task_id, k.name AS task_name, f.title, f.created_at, (SELECT count(*) FROM f) AS total FROM f LEFT JOIN v_tasks k USING (task_id)
ORDER BY f.created_at DESC, f.item_id DESC LIMIT 20 OFFSET 20""")
def q01(t: Tables) -> DataFrame:
    page = search.item_page(t.v_items, t.v_tasks, read=False, created_after="2024-01-08 00:00:00", page=2)
    return page.select("item_id", "task_id", "task_name", "title", "created_at", "total")


PHRASE = "les De"
FOLD_SQL = r"' ' || trim(regexp_replace(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
PHRASE_SQL = f"SELECT item_id FROM v_items WHERE contains({FOLD_SQL.format('title')}, ' les de ') OR contains({FOLD_SQL.format('summary')}, ' les de ')"


@query("q02_phrase_search", check=PHRASE_SQL)
def q02(t: Tables) -> DataFrame:
    return search.phrase_search(t.v_items, PHRASE).select("item_id")


@query("q02_phrase_search_indexed", check=PHRASE_SQL)
def q02_indexed(t: Tables) -> DataFrame:
    return search.phrase_search_indexed(search.token_index(t.v_items), PHRASE)


@query("q02_phrase_search_stored", check=PHRASE_SQL)
def q02_stored(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/index-{uuid4().hex}"
    search.write_token_index(search.token_index(t.v_items), path)
    return search.phrase_search_indexed(t.spark.read.parquet(path), PHRASE)


SUBSTRING_SQL = """SELECT item_id FROM v_items WHERE contains(lower(title), 'tion t') OR contains(lower(summary), 'tion t')"""


@query("q03_substring_search", check=SUBSTRING_SQL)
def q03(t: Tables) -> DataFrame:
    return search.substring_search(t.v_items, "TION t").select("item_id")


@query("q03_substring_search_stored", check=SUBSTRING_SQL)
def q03_stored(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/grams-{uuid4().hex}"
    search.write_token_index(search.gram_index(t.v_items), path)
    return search.substring_search_indexed(t.spark.read.parquet(path), t.v_items, "TION t").select("item_id")


@query("q04_counts_by_source", check="SELECT task_id, count(*) AS total, count(*) FILTER (WHERE NOT is_read) AS unread FROM v_items GROUP BY task_id")
def q04(t: Tables) -> DataFrame:
    return search.counts_by_source(t.v_items)


@query("q05_source_groups", check="""SELECT i.task_id, k.name AS task_name, count(*) AS item_count, count(*) FILTER (WHERE NOT is_read) AS unread_count, max(fetched_at) AS latest_fetched_at,
 arg_max(title, {'t': fetched_at, 'i': item_id}) AS latest_title FROM v_items i LEFT JOIN v_tasks k USING (task_id) GROUP BY ALL""")
def q05(t: Tables) -> DataFrame:
    return search.source_groups(t.v_items, t.v_tasks)


FLAGS_SQL = """SELECT item_id, CASE WHEN interaction_type = 'view' THEN TRUE WHEN interaction_type = 'impression' THEN FALSE END AS is_read,
 CASE WHEN interaction_type = 'star' THEN TRUE WHEN interaction_type = 'not_interested' THEN FALSE END AS is_starred, created_at AS at, interaction_id AS seq FROM v_interactions"""


@query("q06_flag_log", check=f"""WITH c AS ({FLAGS_SQL.replace(' AS at,', ' AS at_,')}),
 s AS (SELECT item_id, arg_max(is_read, {{'t': at_, 's': seq}}) FILTER (WHERE is_read IS NOT NULL) AS r, arg_max(is_starred, {{'t': at_, 's': seq}}) FILTER (WHERE is_starred IS NOT NULL) AS st FROM c GROUP BY item_id)
SELECT i.item_id, coalesce(r, is_read) AS is_read, coalesce(st, is_starred) AS is_starred FROM v_items i LEFT JOIN s USING (item_id)""")
def q06(t: Tables) -> DataFrame:
    return search.apply_flag_log(t.v_items, t.sql(FLAGS_SQL)).select("item_id", "is_read", "is_starred")


# Dashboard ----------------------------------------------------------------------------

@query("a01_totals", check=f"""SELECT (SELECT count(*) FROM v_items) AS total_items, (SELECT count(*) FROM v_items WHERE CAST(fetched_at AS DATE) = DATE '2024-01-30') AS items_today,
 (SELECT count(*) FROM v_executions WHERE CAST(executed_at AS DATE) = DATE '2024-01-30') AS executions_today, (SELECT count(*) FROM v_threads) AS total_threads""")
def a01(t: Tables) -> DataFrame:
    return dashboard.totals(t.v_items, t.v_executions, t.v_threads, TODAY)


@query("a02_task_status", check="""SELECT count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'paused') AS paused, count(*) FILTER (WHERE status = 'error') AS error,
 count(*) AS total FROM v_tasks WHERE deleted_at IS NULL""")
def a02(t: Tables) -> DataFrame:
    return dashboard.task_status(t.v_tasks)


@query("a03_success_rate", check=f"""SELECT count(*) AS total_executions, count(*) FILTER (WHERE status = 'failure') AS failures, round(count(*) FILTER (WHERE status = 'success') / count(*), 3) AS success_rate
FROM v_executions WHERE executed_at >= {NOW} - INTERVAL 7 DAY""")
def a03(t: Tables) -> DataFrame:
    return dashboard.success_rate(t.v_executions, AS_OF)


@query("a04_daily_items", check=f"SELECT CAST(fetched_at AS DATE) AS day, count(*) AS items FROM v_items WHERE fetched_at >= {NOW} - INTERVAL 7 DAY GROUP BY 1")
def a04(t: Tables) -> DataFrame:
    return dashboard.daily_items(t.v_items, AS_OF)


@query("a05_filled_week", check=f"""WITH d AS (SELECT CAST(DATE '2024-01-31' - CAST(i AS INT) AS DATE) AS day FROM range(7) r(i)),
 s AS (SELECT d.day, count(i.item_id) AS items FROM d LEFT JOIN v_items i ON CAST(i.fetched_at AS DATE) = d.day AND i.fetched_at >= {NOW} - INTERVAL 7 DAY GROUP BY d.day)
SELECT day, items, CAST((SELECT sum(items) FROM s) AS BIGINT) AS week_total, (SELECT day FROM s ORDER BY items DESC, day LIMIT 1) AS peak_day FROM s""")
def a05(t: Tables) -> DataFrame:
    return dashboard.filled_week(t.v_items, AS_OF)


@query("a06_top_sources", check=f"""SELECT k.task_id, k.name, count(i.item_id) AS item_count FROM v_tasks k LEFT JOIN v_items i ON i.task_id = k.task_id AND i.fetched_at >= {NOW} - INTERVAL 7 DAY
WHERE k.deleted_at IS NULL GROUP BY ALL ORDER BY item_count DESC, task_id LIMIT 5""")
def a06(t: Tables) -> DataFrame:
    return dashboard.top_sources(t.v_tasks, t.v_items, AS_OF)


# Runs ---------------------------------------------------------------------------------

@query("x01_run_history", check="""WITH r AS (SELECT task_id, execution_id, status, executed_at, row_number() OVER (PARTITION BY task_id ORDER BY executed_at DESC, execution_id DESC) AS position, count(*) OVER (PARTITION BY task_id) AS total FROM v_executions)
SELECT task_id, execution_id, status, executed_at, CAST(position AS INT) AS position, total FROM r WHERE position BETWEEN 21 AND 40""")
def x01(t: Tables) -> DataFrame:
    return monitor.history(t.v_executions, page=2).select("task_id", "execution_id", "status", "executed_at", "position", "total")


@query("x02_latest_run", check="""SELECT task_id, execution_id, status, executed_at FROM v_executions QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY executed_at DESC, execution_id DESC) = 1""")
def x02(t: Tables) -> DataFrame:
    return monitor.latest_run(t.v_executions).select("task_id", "execution_id", "status", "executed_at")


@query("x03_stale_sweep", check=f"""SELECT execution_id, CASE WHEN status = 'warning' THEN 'interrupted' ELSE status END AS status,
 CASE WHEN status = 'warning' THEN '{monitor.INTERRUPTED_MESSAGE}' ELSE error_message END AS error_message FROM v_executions""")
def x03(t: Tables) -> DataFrame:
    started = t.v_executions.withColumn("status", F.when(F.col("status") == "warning", "running").otherwise(F.col("status")))
    return monitor.sweep_stale(started).select("execution_id", "status", "error_message")


ALLOWED_SQL = " OR ".join(f"(previous_state = '{a}' AND state IN ({', '.join(repr(b) for b in bs)}))" for a, bs in monitor.TRANSITIONS.items())


@query("x04_transition_check", check=f"""WITH p AS (SELECT *, lag(state) OVER (PARTITION BY execution_id ORDER BY created_at, event_id) AS previous_state FROM v_run_events)
SELECT event_id, execution_id, state, previous_state, previous_state IS NULL OR {ALLOWED_SQL} AS allowed, state IN {monitor.FINAL_STATES} AS is_final FROM p""")
def x04(t: Tables) -> DataFrame:
    return monitor.check_transitions(t.v_run_events).select("event_id", "execution_id", "state", "previous_state", "allowed", "is_final")


@query("x05_event_sequence", check="SELECT event_id, execution_id, row_number() OVER (PARTITION BY execution_id ORDER BY created_at, event_id) AS seq FROM v_run_events")
def x05(t: Tables) -> DataFrame:
    return monitor.sequence_events(t.v_run_events).select("event_id", "execution_id", "seq")


CURSOR_SQL = "SELECT task_id, max(event_id) AS event_id FROM v_run_events WHERE created_at < TIMESTAMP '2024-01-20 00:00:00' GROUP BY task_id"


@query("x06_replay_after_cursor", check=f"""WITH c AS ({CURSOR_SQL}), p AS (SELECT c.task_id, e.created_at, e.event_id FROM c JOIN v_run_events e USING (task_id, event_id)),
 r AS (SELECT e.task_id, e.event_id, e.state, row_number() OVER (PARTITION BY e.task_id ORDER BY e.created_at, e.event_id) AS position FROM v_run_events e JOIN p ON p.task_id = e.task_id AND (e.created_at > p.created_at OR (e.created_at = p.created_at AND e.event_id > p.event_id)))
SELECT task_id, event_id, state, CAST(position AS INT) AS position FROM r""")
def x06(t: Tables) -> DataFrame:
    return monitor.replay_after(t.v_run_events, t.sql(CURSOR_SQL)).select("task_id", "event_id", "state", "position")


@query("x07_latest_event", check="SELECT execution_id, event_id, state, created_at FROM v_run_events QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY created_at DESC, event_id DESC) = 1")
def x07(t: Tables) -> DataFrame:
    return monitor.latest_events(t.v_run_events).select("execution_id", "event_id", "state", "created_at")


@query("x07_recent_events", check="""SELECT task_id, event_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, event_id DESC) AS INT) AS position FROM v_run_events
QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, event_id DESC) <= 20""")
def x07_recent(t: Tables) -> DataFrame:
    return monitor.recent_events(t.v_run_events).select("task_id", "event_id", "position")


STREAK_SQL = """o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY executed_at, execution_id) AS n FROM v_executions),
 f AS (SELECT *, n - coalesce(max(CASE WHEN status <> 'failure' THEN n END) OVER w, 0) AS fails FROM o WINDOW w AS (PARTITION BY task_id ORDER BY n)),
 lastreset AS (SELECT task_id, coalesce(max(n) FILTER (WHERE status = 'success'), 0) AS at_n FROM o GROUP BY task_id)"""


@query("x08_streaks", check=f"""WITH {STREAK_SQL}, a AS (SELECT task_id, arg_max(fails, n) AS consecutive_failures, max(fails) AS worst, max(executed_at) AS last_executed_at FROM f GROUP BY task_id),
 e AS (SELECT o.task_id, count(*) FILTER (WHERE o.status = 'warning' AND o.n > r.at_n) AS consecutive_empty FROM o JOIN lastreset r USING (task_id) GROUP BY o.task_id)
SELECT a.task_id, consecutive_failures, consecutive_empty, last_executed_at, CASE WHEN worst >= 3 THEN 'error' ELSE k.status END AS status FROM a JOIN e USING (task_id) LEFT JOIN v_tasks k USING (task_id)""")
def x08(t: Tables) -> DataFrame:
    return monitor.streaks(t.v_executions, t.v_tasks)


@query("x09_run_metrics", check="""WITH r AS (SELECT *, CASE WHEN error_message IS NOT NULL THEN 'failure' WHEN items_fetched = 0 THEN 'warning' ELSE 'success' END AS s FROM v_executions)
SELECT task_id, CAST(executed_at AS DATE) AS day, count(*) AS runs, count(*) FILTER (WHERE s = 'success') AS success, count(*) FILTER (WHERE s = 'warning') AS warning, count(*) FILTER (WHERE s = 'failure') AS failure,
 CAST(sum(items_fetched) AS BIGINT) AS items_seen, CAST(sum(items_new) AS BIGINT) AS items_created, CAST(sum(items_fetched - items_new) AS BIGINT) AS items_deduped, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM r GROUP BY ALL""")
def x09(t: Tables) -> DataFrame:
    return monitor.run_metrics(t.v_executions)


COVERAGE_SQL = """cov AS (SELECT task_id, arg_max(items_fetched, {'t': executed_at, 'i': execution_id}) AS f, arg_max(items_new, {'t': executed_at, 'i': execution_id}) AS n FROM v_executions WHERE status IN ('success', 'warning') GROUP BY task_id),
 fc AS (SELECT task_id, CASE WHEN f = 0 THEN 0.0 ELSE least(100.0, n * 100.0 / f) END AS field_coverage FROM cov)"""
FRESH_SQL = f"CASE WHEN (epoch_us({NOW}) - epoch_us(last_executed_at)) <= 3600000000 THEN 100.0 WHEN (epoch_us({NOW}) - epoch_us(last_executed_at)) <= 6 * 3600000000 THEN 90.0 WHEN (epoch_us({NOW}) - epoch_us(last_executed_at)) <= 24 * 3600000000 THEN 70.0 WHEN (epoch_us({NOW}) - epoch_us(last_executed_at)) <= 72 * 3600000000 THEN 40.0 ELSE 10.0 END"


@query("x10_source_health", check=f"""WITH r AS (SELECT * FROM v_executions QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY executed_at DESC, execution_id DESC) <= 50),
 g AS (SELECT task_id, count(*) AS total_executions, count(*) FILTER (WHERE status <> 'failure') * 100.0 / count(*) AS http, count(*) FILTER (WHERE status IN ('success', 'warning')) * 100.0 / count(*) AS parse,
  CASE WHEN sum(items_fetched) = 0 THEN 0.0 ELSE (sum(items_fetched) - sum(items_new)) * 100.0 / sum(items_fetched) END AS dup, max(executed_at) AS last_executed_at FROM r GROUP BY task_id),
 {COVERAGE_SQL}, k AS (SELECT g.*, fc.field_coverage AS fcov, {FRESH_SQL}::DOUBLE AS fresh FROM g LEFT JOIN fc USING (task_id)),
 s AS (SELECT *, 0.3 * http + 0.3 * parse + 0.2 * coalesce(fcov, 0) + 0.1 * fresh + 0.1 * (100 - dup) AS score FROM k)
SELECT v.task_id, coalesce(round(score, 1), 0.0)::DOUBLE AS health_score, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 80 THEN 'healthy' WHEN score >= 50 THEN 'degraded' ELSE 'broken' END AS status,
 coalesce(round(http, 1), 0)::DOUBLE AS http_availability, coalesce(round(parse, 1), 0)::DOUBLE AS parse_success_rate, coalesce(round(fcov, 1), 0)::DOUBLE AS field_coverage, coalesce(fresh, 0)::DOUBLE AS freshness,
 coalesce(round(dup, 1), 0)::DOUBLE AS duplicate_rate, coalesce(total_executions, 0) AS total_executions, last_executed_at FROM v_tasks v LEFT JOIN s USING (task_id)""")
def x10(t: Tables) -> DataFrame:
    return monitor.source_health(t.v_tasks, t.v_executions, AS_OF)


@query("x11_freshness", check=f"WITH l AS (SELECT task_id, max(executed_at) AS last_executed_at FROM v_executions GROUP BY task_id) SELECT task_id, ({FRESH_SQL})::DOUBLE AS freshness FROM l")
def x11(t: Tables) -> DataFrame:
    from newsloom.functions.times import freshness
    latest = monitor.latest_run(t.v_executions)
    return latest.select("task_id", freshness(F.col("executed_at"), AS_OF).alias("freshness"))


@query("x12_duplicate_rate", check="SELECT task_id, round(CASE WHEN sum(items_fetched) = 0 THEN 0.0 ELSE (sum(items_fetched) - sum(items_new)) * 100.0 / sum(items_fetched) END, 4)::DOUBLE AS duplicate_rate FROM v_executions GROUP BY task_id")
def x12(t: Tables) -> DataFrame:
    return monitor.duplicate_rate(t.v_executions).withColumn("duplicate_rate", F.round("duplicate_rate", 4))


@query("x13_field_coverage", check=f"WITH {COVERAGE_SQL} SELECT task_id, round(field_coverage, 4)::DOUBLE AS field_coverage FROM fc")
def x13(t: Tables) -> DataFrame:
    return monitor.field_coverage(t.v_executions).withColumn("field_coverage", F.round("field_coverage", 4))


CRAWLS_SQL = """SELECT task_id || '#' || CAST(CAST(floor(item_id / 200) AS BIGINT) AS STRING) AS crawl_id, CASE WHEN min(item_id) % 7 = 3 THEN 503 ELSE 200 END AS http_status FROM v_items GROUP BY task_id || '#' || CAST(CAST(floor(item_id / 200) AS BIGINT) AS STRING)"""
CRAWLED_SQL = """SELECT task_id || '#' || CAST(CAST(floor(item_id / 200) AS BIGINT) AS STRING) AS crawl_id, title, CASE WHEN item_id % 13 < 3 THEN NULL ELSE url END AS link FROM v_items WHERE NOT contains(url, '77')"""


@query("x14_batch_validation", check=f"""WITH c AS ({CRAWLS_SQL}), i AS ({CRAWLED_SQL}),
 n AS (SELECT crawl_id, count(*) AS n, CAST(sum(CASE WHEN coalesce(title, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(link, '') <> '' THEN 1 ELSE 0 END) AS BIGINT) AS p FROM i GROUP BY crawl_id),
 k AS (SELECT c.crawl_id, http_status, http_status = 200 AS ok, coalesce(n, 0) AS n, CASE WHEN http_status = 200 AND n > 0 THEN p / (n * 2) ELSE 0.0 END AS cov FROM c LEFT JOIN n USING (crawl_id))
SELECT crawl_id, http_status, CASE WHEN ok THEN n ELSE 0 END AS items_found, round(cov, 3) AS field_coverage,
 CASE WHEN NOT ok THEN 'transport_failed' WHEN n = 0 THEN 'parse_failed' WHEN n >= 8 AND cov >= 0.9 THEN 'valid' ELSE 'semantic_failed' END AS status,
 CASE WHEN NOT ok THEN 'HTTP 503' WHEN n = 0 THEN 'No items extracted' END AS error,
 CASE WHEN NOT ok OR n = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN n < 8 THEN 'Items found (' || n || ') < expected minimum (8)' END, CASE WHEN cov < 0.9 THEN printf('Field coverage (%.1f%%) < minimum (90.0%%)', cov * 100) END], lambda w: w IS NOT NULL), '; ') END AS warnings FROM k""")
def x14(t: Tables) -> DataFrame:
    checked = monitor.validate_batches(t.sql(CRAWLS_SQL), t.sql(CRAWLED_SQL), min_items=8)
    return checked.withColumn("warnings", F.array_join("warnings", "; "))


CONFIG_SQL = """SELECT task_id, source_url, CASE WHEN status = 'paused' THEN ' ' ELSE 'li' END AS selector_list, CASE WHEN content_kind = 'catalog' THEN NULL ELSE 'a' END AS selector_title, 'a' AS selector_link FROM v_tasks"""


@query("x15_missing_config", check=f"""WITH c AS ({CONFIG_SQL}) SELECT task_id, array_to_string(list_filter([CASE WHEN source_url IS NULL THEN '来源 URL' END, CASE WHEN trim(selector_list) = '' THEN '列表项 Selector' END,
 CASE WHEN selector_title IS NULL THEN '标题 Selector' END], lambda w: w IS NOT NULL), ', ') AS missing FROM c""")
def x15(t: Tables) -> DataFrame:
    return monitor.missing_config(t.sql(CONFIG_SQL)).withColumn("missing", F.array_join("missing", ", "))


@query("x16_retention", check=f"""WITH gone AS (SELECT task_id FROM v_tasks WHERE deleted_at < {NOW} - INTERVAL 30 DAY)
SELECT 'task' AS kind, task_id, count(*) AS rows_left FROM v_tasks WHERE task_id NOT IN (SELECT task_id FROM gone) GROUP BY ALL
UNION ALL SELECT 'item', task_id, count(*) FROM v_items WHERE task_id NOT IN (SELECT task_id FROM gone) GROUP BY ALL
UNION ALL SELECT 'execution', task_id, count(*) FROM v_executions WHERE task_id NOT IN (SELECT task_id FROM gone) GROUP BY ALL""")
def x16(t: Tables) -> DataFrame:
    tasks, left = monitor.purge_expired(t.v_tasks, {"item": t.v_items, "execution": t.v_executions}, AS_OF)
    parts = {"task": tasks, **left}
    counted = [df.groupBy(F.lit(kind).alias("kind"), "task_id").agg(F.count("*").alias("rows_left")) for kind, df in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("x18_template_ranking", check="""SELECT p_partkey AS template_id, p_name AS name, p_type AS category, p_partkey AS created_seq, count(l.l_partkey) AS share_count
FROM part LEFT JOIN lineitem l ON l.l_partkey = p_partkey WHERE p_type = 'ECONOMY' GROUP BY ALL""")
def x18(t: Tables) -> DataFrame:
    templates = t.part.select(F.col("p_partkey").alias("template_id"), F.col("p_name").alias("name"),
                              F.col("p_type").alias("category"), F.col("p_partkey").alias("created_seq"))
    imports = t.lineitem.select(F.col("l_partkey").alias("template_id"))
    return monitor.rank_templates(templates, imports, category="ECONOMY")


# Ledger -------------------------------------------------------------------------------

HASHED_SQL = "h AS (SELECT *, sha256(model || chr(0) || system || chr(0) || prompt) AS prompt_hash FROM v_receipts)"


def hashed(t: Tables) -> DataFrame:
    return t.v_receipts.withColumn("prompt_hash", ledger.prompt_hash(F.col("model"), F.col("system"), F.col("prompt")))


@query("l01_prompt_hash", check=f"WITH {HASHED_SQL} SELECT receipt_id, prompt_hash FROM h")
def l01(t: Tables) -> DataFrame:
    return hashed(t).select("receipt_id", "prompt_hash")


@query("l02_reusable_results", check=f"""WITH {HASHED_SQL}, u AS (SELECT conv_id * 1000 + turn AS prompt_id, sha256('model-a' || chr(0) || 'be brief' || chr(0) || text) AS prompt_hash FROM conversations),
 d AS (SELECT model, prompt_hash, arg_max(result_text, {{'t': created_at, 'r': receipt_id}}) AS reused_text FROM h WHERE status = 'done' GROUP BY ALL)
SELECT prompt_id, reused_text, reused_text IS NULL AS to_call FROM u LEFT JOIN d USING (prompt_hash)""")
def l02(t: Tables) -> DataFrame:
    prompts = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), F.lit("model-a").alias("model"),
        ledger.prompt_hash(F.lit("model-a"), F.lit("be brief"), F.col("text")).alias("prompt_hash"))
    return ledger.split_reusable(prompts, hashed(t)).select("prompt_id", "reused_text", "to_call")


@query("l03_budget_left", check="""SELECT coalesce(CAST(sum(input_tokens + output_tokens) AS BIGINT), 0) AS used_tokens, greatest(0, 200000 - coalesce(CAST(sum(input_tokens + output_tokens) AS BIGINT), 0)) AS remaining_tokens
FROM v_receipts WHERE CAST(created_at AS DATE) = DATE '2024-01-01'""")
def l03(t: Tables) -> DataFrame:
    return ledger.budget_left(t.v_receipts, "2024-01-01 12:00:00")


@query("l04_daily_usage", check="""SELECT CAST(created_at AS DATE) AS day, count(*) AS calls, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed,
 CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM v_receipts GROUP BY ALL""")
def l04(t: Tables) -> DataFrame:
    return ledger.daily_usage(t.v_receipts)


@query("l04_recent_receipts", check="SELECT receipt_id, status, created_at, (SELECT count(*) FROM v_receipts) AS total FROM v_receipts ORDER BY created_at DESC, receipt_id DESC LIMIT 20")
def l04_recent(t: Tables) -> DataFrame:
    return ledger.recent_receipts(t.v_receipts).select("receipt_id", "status", "created_at", "total")


@query("l05_budget_breaker_audit", check="""WITH r AS (SELECT *, CASE WHEN output_tokens % 3 > 0 THEN 'failed' ELSE 'done' END AS st FROM v_receipts),
 o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY created_at, receipt_id) AS n FROM r),
 k AS (SELECT receipt_id, created_at, coalesce(CAST(sum(input_tokens + output_tokens) OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at, receipt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS used_before,
  n - 1 - coalesce(max(CASE WHEN st = 'done' THEN n END) OVER (PARTITION BY model ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failures_before FROM o)
SELECT receipt_id, created_at, used_before, failures_before, used_before < 20000 AS within_budget, failures_before >= 5 AS breaker_open FROM k""")
def l05(t: Tables) -> DataFrame:
    shaky = t.v_receipts.withColumn("status", F.when(F.col("output_tokens") % 3 > 0, "failed").otherwise("done"))
    return ledger.audit(shaky, budget=20_000).select("receipt_id", "created_at", "used_before", "failures_before", "within_budget", "breaker_open")
