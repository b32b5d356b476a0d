"""Queries over sources, sinks and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import dedup
from newsloom.plans.fixtures import Tables
from newsloom.plans.registry import query
from newsloom.plans.text_plans import HREFS_SQL
from newsloom.sources import catalog, crawl_log, feed, html_pages, json_payload, modes, tables

STRIP_SQL = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def strip_sql(col: str) -> str:
    return STRIP_SQL.format(col)


@query("s01_scan_events", check="""SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def s01(t: Tables) -> DataFrame:
    decoded = tables.decode_columns(t.events, {"props": "map<string,bigint>"})
    return decoded.select("event_id", "ts", "user_id", "event_type", "value", F.col("props")["k"].alias("k"))


def page_of(items: DataFrame) -> DataFrame:
    """Number of the crawl page an item came from: 20 consecutive items of its source."""
    return items.withColumn("page_no", (F.col("item_id") / 400).cast("bigint"))


def json_payloads(items: DataFrame) -> DataFrame:
    """One JSON body per source and crawl page, list under data.items."""
    fields = F.struct("item_id", "title", "url", "summary")
    return page_of(items).groupBy("task_id", "page_no").agg(
        F.to_json(F.struct(F.struct(F.collect_list(fields).alias("items")).alias("data"))).alias("body")
    ).withColumn("base_url", F.concat(F.lit("https://"), F.col("task_id"), F.lit(".example.com/")))


@query("s02_json_items", check=rf"""WITH n AS (SELECT task_id, CAST(floor(item_id / 400) AS BIGINT) AS page_no, count(*) AS raw_count FROM v_items GROUP BY 1, 2)
SELECT i.task_id, n.page_no, CAST(n.raw_count AS INT) AS raw_count, {strip_sql('i.title')} AS title, i.url, left({strip_sql('i.summary')}, 400) AS summary
FROM v_items i JOIN n ON n.task_id = i.task_id AND n.page_no = CAST(floor(i.item_id / 400) AS BIGINT) WHERE {strip_sql('i.title')} <> ''""")
def s02(t: Tables) -> DataFrame:
    return json_payload.json_items(json_payloads(t.v_items), "data.items", "title", "url", "summary").drop("base_url")


@query("s03_json_links", check="""SELECT task_id, 'https://hub.example.org/p/' || item_id AS url FROM v_items WHERE length(trim(title)) > 0
UNION ALL SELECT task_id, 'https://' || task_id || '.example.com/' || CAST(item_id % 900 AS VARCHAR) AS url FROM v_items WHERE length(trim(title)) > 0""")
def s03(t: Tables) -> DataFrame:
    relative = t.v_items.withColumn("url", F.concat(F.lit("../"), (F.col("item_id") % 900).cast("string")))
    bodies = json_payloads(relative).withColumn("base_url", F.concat("base_url", F.lit("list/page")))
    glued = json_payload.json_items(bodies, "data.items", link="PREF:https://hub.example.org/p/|item_id")
    joined = json_payload.json_items(bodies, "data.items", link="url")
    return glued.select("task_id", "url").unionByName(joined.select("task_id", "url"))


NEWEST_SQL = """n AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, item_id DESC) AS rank FROM v_items)"""
XML_SAFE = r"regexp_replace({0}, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')"


@query("s04_feed_items", check=rf"""WITH {NEWEST_SQL}
SELECT task_id AS feed_key, {strip_sql('title')} AS title, url, left({strip_sql("regexp_replace(summary, '<[^>]+>', '', 'g')")}, 200) AS summary FROM n WHERE rank <= 100""")
def s04(t: Tables) -> DataFrame:
    bodies = feed.build_feeds(t.v_items, t.v_tasks, "https://reader.example.com", "Items")
    return feed.feed_items(bodies, "xml")


@query("s05_html_list_items", check=f"""SELECT page_id, href, CAST(count(*) AS BIGINT) AS n FROM (
 SELECT page_id, CASE WHEN starts_with(href, 'http') THEN href ELSE regexp_extract(url, '^(https?://[^/?#]*)', 1) || href END AS href FROM ({HREFS_SQL})) GROUP BY ALL""")
def s05(t: Tables) -> DataFrame:
    links = html_pages.linked_list_items(t.pages)
    return links.groupBy("page_id", F.col("link").alias("href")).agg(F.count("*").alias("n"))




def hits_sql(selector: str) -> str:
    tag, _, css = selector.partition(".")
    tag = tag or "[a-zA-Z][a-zA-Z0-9]*"
    if not css:
        return rf"len(regexp_extract_all(html, '(?i)<{tag}\b'))"
    return rf"""len(regexp_extract_all(html, '(?i)<{tag}\s(?:[^>]*\s)?class="(?:[^"]*\s)?{css}(?:\s[^"]*)?"'))"""


@query("s06_page_profile", check=rf"""WITH k AS (SELECT page_id, url, html, [{", ".join(hits_sql(s) for s in html_pages.LIST_SELECTORS)}] AS hits FROM pages)
SELECT page_id, url, CASE WHEN regexp_matches(html, '(?i)<(rss|feed|channel)\b') THEN 'rss' WHEN regexp_matches(trim(html), '^[{{\[]') THEN 'json' ELSE 'html' END AS kind,
 {strip_sql("replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')")} AS title,
 replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<meta\s+name="description"\s+content="([^"]*)"', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS description,
 array_to_string(hits, ',') AS hits, coalesce(list_filter({list(html_pages.LIST_SELECTORS)}, lambda s, i: hits[i] >= 3)[1], '') AS list_selector,
 CAST(len(regexp_extract_all(html, '(?i)<a\s[^>]*href=')) AS INT) AS links FROM k""")
def s06(t: Tables) -> DataFrame:
    return html_pages.page_profile(t.pages).withColumn("hits", F.array_join("hits", ","))


@query("s07_json_shape", check="""SELECT task_id, 'data.items' AS list_path, 'title' AS title_field, 'url' AS link_field, 'summary' AS summary_field,
 CAST(count(DISTINCT floor(item_id / 400)) AS BIGINT) AS payloads FROM v_items GROUP BY task_id""")
def s07(t: Tables) -> DataFrame:
    return json_payload.infer_shape(json_payloads(t.v_items), "task_id")


LOG_SQL = """SELECT task_id AS crawl_id, item_id, 1 + CAST(floor(item_id / 140) AS BIGINT) AS page_no, item_id AS item_no,
 'https://' || task_id || '.example.com/' || CAST(CAST(floor(item_id / 20) AS BIGINT) % 7 + 7 * least(CAST(floor(item_id / 140) AS BIGINT), CAST(substring(task_id, 4) AS BIGINT) % 6 + 1) AS STRING) AS url,
 NOT contains(title, 'z') AS kept FROM v_items"""


@query("s08_crawl_trim", check=f"""WITH l AS ({LOG_SQL}), p AS (SELECT crawl_id, page_no, list_sort(list(DISTINCT url)) AS urls FROM l WHERE page_no <= 10 GROUP BY ALL),
 stop AS (SELECT b.crawl_id, min(b.page_no) AS stop_at FROM p a JOIN p b ON a.crawl_id = b.crawl_id AND b.page_no = a.page_no + 1 AND a.urls = b.urls GROUP BY ALL),
 k AS (SELECT l.*, row_number() OVER (PARTITION BY l.crawl_id ORDER BY l.page_no, l.item_no) AS item_order FROM l LEFT JOIN stop USING (crawl_id)
  WHERE kept AND l.page_no <= 10 AND (stop_at IS NULL OR l.page_no < stop_at))
SELECT crawl_id, page_no, item_id, url, sha256(url) AS url_hash, item_order FROM k WHERE item_order <= 30""")
def s08(t: Tables) -> DataFrame:
    return crawl_log.trim_crawls(t.sql(LOG_SQL), max_pages=10, max_items=30).select(
        "crawl_id", "page_no", "item_id", "url", "url_hash", F.col("item_order").cast("bigint").alias("item_order"))


def esc_sql(col: str) -> str:
    return f"replace(replace(replace({col}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("s09_feed_documents", check=rf"""WITH {NEWEST_SQL},
 e AS (SELECT n.task_id, k.name, n.rank, array_to_string(['<item>', '<title>' || {esc_sql("CASE WHEN n.title = '' THEN '(untitled)' ELSE n.title END")} || '</title>',
  '<link>' || {esc_sql('n.url')} || '</link>', '<guid isPermaLink="false">' || n.item_id || '</guid>',
  '<pubDate>' || strftime(n.fetched_at, '%a, %d %b %Y %H:%M:%S +0000') || '</pubDate>', '<category>' || k.name || '</category>',
  '<description>' || {esc_sql('n.summary')} || '</description>', '</item>'], chr(10)) AS xml FROM n JOIN v_tasks k USING (task_id) WHERE rank <= 100)
SELECT task_id AS feed_key, array_to_string(['<?xml version="1.0" encoding="UTF-8"?>', '<rss version="2.0">', '<channel>', '<title>Items · ' || max(name) || '</title>',
 '<link>https://reader.example.com</link>', '<description>Items</description>', string_agg(xml, chr(10) ORDER BY rank), '</channel>', '</rss>'], chr(10)) AS xml FROM e GROUP BY task_id""")
def s09(t: Tables) -> DataFrame:
    return feed.build_feeds(t.v_items, t.v_tasks, "https://reader.example.com", "Items")


@query("s09_newest_items", check="""SELECT item_id, CAST(row_number() OVER (ORDER BY created_at DESC, item_id DESC) AS INT) AS rank FROM v_items ORDER BY rank LIMIT 100""")
def s09_all(t: Tables) -> DataFrame:
    return feed.newest_items(t.v_items, per=None).select("item_id", "rank")


@query("s10_gold_labels", check="""SELECT CAST(doc_id AS VARCHAR) AS item_id, quality = 1 AS relevant FROM labels""")
def s10(t: Tables) -> DataFrame:
    lines = t.labels.select(F.to_json(F.struct(F.col("doc_id").alias("item_id"), F.col("quality").alias("relevant"))).alias("value"))
    return catalog.gold_labels(lines)


TEMPLATE_SQL = """SELECT 'tpl' || CAST(p_partkey % 20 AS STRING) AS template_id, max(p_name) AS selector_list, max(p_type) AS selector_title FROM part GROUP BY 1"""


@query("s11_template_fill", check=f"""WITH tpl AS ({TEMPLATE_SQL.replace('GROUP BY 1', "GROUP BY 'tpl' || CAST(p_partkey % 20 AS STRING)")}),
 u AS (SELECT task_id, 'tpl' || substring(task_id, 4) AS template_id, CASE WHEN status = 'paused' THEN '  ' WHEN source_url IS NULL THEN NULL ELSE 'own' END AS selector_list, CAST(NULL AS VARCHAR) AS selector_title FROM v_tasks)
SELECT u.task_id, coalesce(CASE WHEN trim(u.selector_list) <> '' THEN u.selector_list END, tpl.selector_list) AS selector_list, coalesce(u.selector_title, tpl.selector_title) AS selector_title,
 tpl.selector_list AS snapshot_list FROM u LEFT JOIN tpl USING (template_id)""")
def s11(t: Tables) -> DataFrame:
    templates = t.sql(TEMPLATE_SQL)
    own = F.when(F.col("status") == "paused", "  ").when(F.col("source_url").isNotNull(), "own")
    tasks = t.v_tasks.select(
        "task_id", F.concat(F.lit("tpl"), F.substring("task_id", 4, 9)).alias("template_id"),
        own.alias("selector_list"), F.lit(None).cast("string").alias("selector_title"))
    filled = catalog.apply_templates(tasks, templates, ["selector_list", "selector_title"])
    return filled.select("task_id", "selector_list", "selector_title", F.col("template_snapshot.selector_list").alias("snapshot_list"))


@query("s12_compact_items", check="""SELECT i.item_id, i.title, i.url, i.summary, k.name AS task_name, i.fetched_at, i.is_read, i.is_starred
FROM v_items i JOIN v_tasks k USING (task_id) ORDER BY i.created_at DESC, i.item_id DESC LIMIT 500""")
def s12(t: Tables) -> DataFrame:
    return feed.compact_items(t.v_items, t.v_tasks, 500)


@query("s12_compact_threads", check="""SELECT thread_id, title, item_count, first_seen_at, last_seen_at FROM v_threads ORDER BY first_seen_at DESC, thread_id DESC LIMIT 20""")
def s12_threads(t: Tables) -> DataFrame:
    return feed.compact_threads(t.v_threads)


@query("s12_compact_tasks", check="""SELECT task_id, name, status, source_url, content_kind FROM v_tasks WHERE deleted_at IS NULL ORDER BY name LIMIT 20""")
def s12_tasks(t: Tables) -> DataFrame:
    return feed.compact_tasks(t.v_tasks)


# Deduplication ------------------------------------------------------------------------

CONTENT_SQL = f"sha256({strip_sql('title')} || '|' || {strip_sql('summary')})"


@query("d05_content_hash", check=f"SELECT item_id, {CONTENT_SQL} AS content_hash FROM v_items")
def d05(t: Tables) -> DataFrame:
    return t.v_items.select("item_id", dedup.content_hash(F.col("title"), F.col("summary")).alias("content_hash"))


@query("d06_title_fingerprint", check=r"""WITH k AS (SELECT item_id, trim(regexp_replace(lower(nfc_normalize(title)), '[^\p{L}\p{N}_]+', ' ', 'g')) AS n FROM v_items_mixed)
SELECT item_id, CASE WHEN n = '' THEN '' ELSE sha256(n)[1:16] END AS fingerprint FROM k""")
def d06(t: Tables) -> DataFrame:
    from newsloom.functions.labels import title_fingerprint
    return t.v_items_mixed.select("item_id", title_fingerprint(F.col("title")).alias("fingerprint"))


# History is what was created before this moment, the batch is the rest.
SPLIT = "2024-01-16 00:00:00"
KEYED_SQL = f"k AS (SELECT *, sha256(url) AS url_hash, {CONTENT_SQL} AS content_hash FROM v_items), h AS (SELECT * FROM k WHERE created_at < TIMESTAMP '{SPLIT}'), b AS (SELECT * FROM k WHERE created_at >= TIMESTAMP '{SPLIT}')"
FRESH_SQL = """f AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.task_id = b.task_id AND h.external_id = b.external_id)
 AND NOT EXISTS (SELECT 1 FROM h WHERE h.url_hash = b.url_hash) AND NOT EXISTS (SELECT 1 FROM h WHERE h.content_hash = b.content_hash))"""


def history_and_batch(t: Tables) -> tuple[DataFrame, DataFrame]:
    keyed = dedup.with_keys(t.v_items)
    border = F.lit(SPLIT).cast("timestamp_ntz")
    return keyed.filter(F.col("created_at") < border), keyed.filter(F.col("created_at") >= border)


@query("d07_drop_known", check=f"WITH {KEYED_SQL}, {FRESH_SQL} SELECT item_id, task_id, url_hash, content_hash FROM f")
def d07(t: Tables) -> DataFrame:
    history, batch = history_and_batch(t)
    return dedup.drop_known(batch, history).select("item_id", "task_id", "url_hash", "content_hash")


# Row by row in arrival order: a row is kept if no kept row has its URL or its external id.
_TAKEN = "list_contains(r.us, k.u) OR coalesce(list_contains(r.es, k.e), false)"


def inserted_sql(rows: str) -> str:
    return f"""WITH RECURSIVE b AS ({rows}), k AS (SELECT item_id, task_id, external_id, sha256(url) AS u,
 task_id || '|' || nullif(external_id, '') AS e, row_number() OVER (ORDER BY created_at, item_id) AS n FROM b),
 r AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS us, CAST([] AS VARCHAR[]) AS es, false AS kept UNION ALL
  SELECT k.n, CASE WHEN {_TAKEN} THEN r.us ELSE list_append(r.us, k.u) END,
   CASE WHEN k.e IS NULL OR {_TAKEN} THEN r.es ELSE list_append(r.es, k.e) END, NOT ({_TAKEN}) FROM r JOIN k ON k.n = r.n + 1)
SELECT k.item_id, k.task_id, k.external_id, k.u AS url_hash FROM r JOIN k ON k.n = r.n WHERE r.kept"""


def inserted(rows: DataFrame) -> DataFrame:
    return dedup.unique_in_batch(dedup.with_keys(rows)).select("item_id", "task_id", "external_id", "url_hash")


@query("d08_unique_in_batch", check=inserted_sql("SELECT * FROM v_items"))
def d08(t: Tables) -> DataFrame:
    return inserted(t.v_items)


# Keys that cross: a row that loses by its external id must not take its URL, and the other way round.
CROSSED_SQL = """SELECT item_id, task_id, title, summary, created_at, 'https://e.com/' || CAST((item_id * 7) % 450 AS STRING) AS url,
 CASE WHEN item_id % 5 > 0 THEN 'x' || CAST(item_id % 7 AS STRING) END AS external_id FROM v_items"""


@query("d08_crossed_keys", check=inserted_sql(CROSSED_SQL))
def d08_crossed(t: Tables) -> DataFrame:
    return inserted(t.sql(CROSSED_SQL))



@query("d09_dedup_accounting", check=f"""WITH {KEYED_SQL}, {FRESH_SQL}
SELECT b.task_id, count(*) AS items_seen, count(f.item_id) AS items_new, count(*) - count(f.item_id) AS items_duplicate
FROM b LEFT JOIN f USING (item_id) GROUP BY b.task_id""")
def d09(t: Tables) -> DataFrame:
    history, batch = history_and_batch(t)
    return dedup.dedup_accounting(batch, dedup.drop_known(batch, history))


@query("d11_first_per_topic", check="""WITH k AS (SELECT lower(lang) AS topic, source AS category, doc_id AS seq FROM documents)
SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY topic ORDER BY seq) = 1""")
def d11(t: Tables) -> DataFrame:
    topics = t.documents.select(F.lower("lang").alias("topic"), F.col("source").alias("category"), F.col("doc_id").alias("seq"))
    return dedup.first_per_topic(topics)


# Selectors of every kind, derived from the sources.
SELECTOR_SQL = """SELECT task_id, CASE CAST(substring(task_id, 4) AS INT) % 5 WHEN 0 THEN 'json: data.items ' WHEN 1 THEN 'json-post:data.items|||' || chr(123) || '"page":1' || chr(125)
 WHEN 2 THEN 'json-post: data.items |||[1]' WHEN 3 THEN 'rss:' ELSE 'li' END AS selector FROM v_tasks"""


@query("u03_source_modes", check=f"""WITH s AS ({SELECTOR_SQL}), m AS (SELECT task_id, CAST(substring(task_id, 4) AS INT) % 5 AS k FROM s)
SELECT task_id, ['json', 'json-post', 'json-post', 'rss', 'html'][k + 1] AS mode, ['data.items', 'data.items', 'data.items', '', 'li'][k + 1] AS path,
 CASE k WHEN 1 THEN '{{"page":1}}' WHEN 2 THEN '{{}}' END AS post_body FROM m""")
def u03(t: Tables) -> DataFrame:
    return t.sql(SELECTOR_SQL).select("task_id", modes.source_mode(F.col("selector")).alias("m")).select("task_id", "m.*")


@query("u03_items_by_mode", check=rf"""SELECT task_id, CASE WHEN CAST(substring(task_id, 4) AS INT) % 5 = 0 THEN 'json' ELSE 'json-post' END AS mode, {strip_sql('title')} AS title, url
FROM v_items WHERE CAST(substring(task_id, 4) AS INT) % 5 < 3 AND {strip_sql('title')} <> ''
UNION ALL SELECT * FROM (WITH {NEWEST_SQL} SELECT task_id, 'rss' AS mode, {strip_sql('title')} AS title, url FROM n WHERE rank <= 100 AND CAST(substring(task_id, 4) AS INT) % 5 = 3)""")
def u03_items(t: Tables) -> DataFrame:
    bodies = json_payloads(t.v_items).select("task_id", "base_url", "body")
    feeds = feed.build_feeds(t.v_items, t.v_tasks, "https://reader.example.com", "Items").select(
        F.col("feed_key").alias("task_id"), F.lit("").alias("base_url"), F.col("xml").alias("body"))
    sent = bodies.unionByName(feeds).join(t.sql(SELECTOR_SQL), "task_id")
    rss = F.col("selector") == "rss:"
    sent = sent.filter(rss == F.col("body").startswith("<?xml"))
    return modes.items_by_mode(sent, {"json": ("data.items",), "json-post": ("data.items",)})
