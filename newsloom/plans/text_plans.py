"""Queries over text, date and math column expressions (items, documents, title pairs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import entities, labels, text, times, urls
from newsloom.operators import dictionary, features, vectors
from newsloom.plans.fixtures import AS_OF, Tables
from newsloom.plans.registry import query

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


def norm_sql(col: str) -> str:
    return rf"trim(regexp_replace(lower(nfc_normalize({col})), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def tokens_sql(col: str) -> str:
    """Distinct tokens in first-seen order."""
    split = f"string_split({norm_sql(col)}, ' ')"
    kept = f"list_filter({split}, lambda t: length(t) > 1 AND NOT list_contains({STOP_SQL}, t))"
    return (f"list_transform(list_filter(list_transform({kept}, lambda t, i: {{'t': t, 'i': i}}), "
            f"lambda r: list_position({kept}, r.t) = r.i), lambda r: r.t)")


def token_set_sql(col: str) -> str:
    return (f"list_sort(list_distinct(list_filter(string_split({norm_sql(col)}, ' '), "
            f"lambda t: length(t) > 1 AND NOT list_contains({STOP_SQL}, t))))")


def jaccard_sql(a: str, b: str) -> str:
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE "
            f"len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END")


def grams_sql(col: str) -> str:
    clean = rf"regexp_replace(lower({col}), '[^\p{{L}}\p{{N}}_]', '', 'g')"
    return (f"CASE WHEN {col} = '' THEN []::VARCHAR[] WHEN length({clean}) < 2 THEN [{clean}] ELSE "
            f"list_distinct(list_transform(range(1, length({clean})), lambda i: substring({clean}, CAST(i AS INT), 2))) END")


def contains_sql(col: str, needles) -> str:
    return "(" + " OR ".join(f"contains({col}, '{n}')" for n in needles) + ")"


def rules_sql(col: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {contains_sql(col, ns)} THEN '{lab}'" for lab, ns in rules) + f" ELSE '{default}' END"


# Title pairs: an item against the item of the next id.
PAIRS_SQL = """SELECT a.item_id AS item_a, b.item_id AS item_b, a.title AS title_a, b.title AS title_b,
 a.summary AS summary_a, b.summary AS summary_b, a.fetched_at AS ts_a, b.fetched_at AS ts_b, a.task_id AS task_a, b.task_id AS task_b
FROM v_items a JOIN v_items b ON b.item_id = a.item_id + 1"""


def title_pairs(t: Tables) -> DataFrame:
    return t.sql(PAIRS_SQL)


@query("f01_normalize_text", check=f"SELECT doc_id, {norm_sql('text')} AS normalized FROM documents")
def f01(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.normalize_text(text.to_nfc(F.col("text"))).alias("normalized"))


# Every other text with its accents as marks of their own.
MIXED_SQL = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(replace(text, 'é', 'e\u0301'), 'ü', 'u\u0308') ELSE text END AS text FROM documents"""


@query("f02_tokenize", check=f"WITH d AS ({MIXED_SQL}) SELECT doc_id, array_to_string({token_set_sql('text')}, ' ') AS tokens FROM d")
def f02(t: Tables) -> DataFrame:
    return t.sql(MIXED_SQL).select(
        "doc_id", F.array_join(F.sort_array(text.tokenize(F.col("text"))), " ").alias("tokens"))


@query("f03_title_jaccard", check=f"""WITH p AS MATERIALIZED ({PAIRS_SQL}),
 k AS MATERIALIZED (SELECT item_a, item_b, {token_set_sql('title_a')} AS ta, {token_set_sql('title_b')} AS tb FROM p)
SELECT item_a, item_b, round({jaccard_sql('ta', 'tb')}, 6) AS jaccard FROM k""")
def f03(t: Tables) -> DataFrame:
    return title_pairs(t).select(
        "item_a", "item_b", F.round(text.title_jaccard(F.col("title_a"), F.col("title_b")), 6).alias("jaccard"))


@query("f04_is_similar", check=f"""WITH p AS MATERIALIZED ({PAIRS_SQL}),
 k AS MATERIALIZED (SELECT item_a, item_b, {token_set_sql('title_a')} AS ta, {token_set_sql('title_b')} AS tb FROM p)
SELECT item_a, item_b, {jaccard_sql('ta', 'tb')} >= 0.35 AS similar FROM k""")
def f04(t: Tables) -> DataFrame:
    return title_pairs(t).select(
        "item_a", "item_b", text.is_similar(F.col("title_a"), F.col("title_b")).alias("similar"))


@query("f05_char_ngrams", check=f"""SELECT item_id, array_to_string(list_sort({grams_sql('title')}), '|') AS grams FROM v_items""")
def f05(t: Tables) -> DataFrame:
    return t.v_items.select(
        "item_id", F.array_join(F.sort_array(text.char_ngrams(F.col("title"))), "|").alias("grams"))


@query("f06_ngram_similarity", check=f"""WITH p AS MATERIALIZED ({PAIRS_SQL}),
 k AS MATERIALIZED (SELECT item_a, item_b, {grams_sql('title_a')} AS ga, {grams_sql('title_b')} AS gb FROM p)
SELECT item_a, item_b, round({jaccard_sql('ga', 'gb')}, 6) AS similarity FROM k""")
def f06(t: Tables) -> DataFrame:
    return title_pairs(t).select(
        "item_a", "item_b", F.round(text.ngram_similarity(F.col("title_a"), F.col("title_b")), 6).alias("similarity"))


@query("f07_embedding_cosine", check="""WITH c AS (SELECT label, min_by(embedding, vec_id) AS lead FROM embeddings GROUP BY label),
 d AS (SELECT e.vec_id, e.label, list_dot_product(e.embedding::DOUBLE[], c.lead::DOUBLE[]) AS p,
  sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS na, sqrt(list_dot_product(c.lead::DOUBLE[], c.lead::DOUBLE[])) AS nb
  FROM embeddings e JOIN c ON c.label = e.label)
SELECT vec_id, label, round(greatest(0.0, least(1.0, p / (na * nb + 1e-8))), 4) AS similarity FROM d""")
def f07(t: Tables) -> DataFrame:
    lead = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("lead")) \
        .withColumn("lead_norm", text.norm(F.col("lead")))
    return t.embeddings.join(lead, "label").select(
        "vec_id", "label",
        F.round(text.cosine(F.col("embedding"), F.col("lead"), text.norm(F.col("embedding")),
                            F.col("lead_norm"), eps=1e-8), 4).alias("similarity"))


@query("f08_language", check=r"""SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'unknown'
 WHEN len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]'))::DOUBLE / length(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) > 0.3 THEN 'zh' ELSE 'en' END AS language
FROM documents""")
def f08(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", labels.language(F.col("text")).alias("language"))


JOINED = "lower(title || ' ' || coalesce(summary, ''))"


@query("f09_content_type", check=f"SELECT item_id, {rules_sql(JOINED, labels.CONTENT_TYPES, 'article')} AS content_type FROM v_items")
def f09(t: Tables) -> DataFrame:
    return t.v_items.select("item_id", labels.content_type(F.col("title"), F.col("summary")).alias("content_type"))


@query("f10_event_type", check=f"SELECT item_id, {rules_sql(JOINED, labels.EVENT_TYPES, 'default')} AS event_type FROM v_items")
def f10(t: Tables) -> DataFrame:
    return t.v_items.select("item_id", labels.event_type(F.col("title"), F.col("summary")).alias("event_type"))


WINDOW_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in labels.EVENT_WINDOWS.items()) + " ELSE 24.0 END::DOUBLE"


@query("f11_event_window", check=f"""WITH k AS (SELECT item_id, {rules_sql(JOINED, labels.EVENT_TYPES, 'default')} AS kind FROM v_items)
SELECT item_id, {WINDOW_SQL} AS window_hours FROM k""")
def f11(t: Tables) -> DataFrame:
    kind = labels.event_type(F.col("title"), F.col("summary"))
    return t.v_items.select("item_id", labels.event_window_hours(kind).alias("window_hours"))


GAP_SQL = "abs(epoch_us(ts_a) - epoch_us(ts_b)) / 3600000000.0"


@query("f12_temporal_score", check=f"""WITH p AS MATERIALIZED ({PAIRS_SQL}),
 k AS MATERIALIZED (SELECT item_a, item_b, {GAP_SQL} AS gap, {rules_sql("lower(title_a || ' ' || summary_a)", labels.EVENT_TYPES, 'default')} AS kind FROM p)
SELECT item_a, item_b, CASE WHEN gap <= 6 THEN 1.0 WHEN gap <= 24 THEN 0.8 WHEN gap <= 72 THEN 0.5 WHEN gap <= {WINDOW_SQL} THEN 0.3 ELSE 0.1 END::DOUBLE AS score FROM k""")
def f12(t: Tables) -> DataFrame:
    kind = labels.event_type(F.col("title_a"), F.col("summary_a"))
    return title_pairs(t).select(
        "item_a", "item_b",
        times.temporal_score(F.col("ts_a"), F.col("ts_b"), labels.event_window_hours(kind)).alias("score"))


@query("f13_temporal_steps", check=f"""WITH p AS ({PAIRS_SQL}), k AS (SELECT item_a, item_b, {GAP_SQL} AS gap FROM p)
SELECT item_a, item_b, CASE WHEN gap <= 6 THEN 1.0 WHEN gap <= 24 THEN 0.8 WHEN gap <= 72 THEN 0.5 ELSE 0.1 END::DOUBLE AS score FROM k""")
def f13(t: Tables) -> DataFrame:
    gap = F.abs(times.hours_between(F.col("ts_a"), F.col("ts_b")))
    return title_pairs(t).select("item_a", "item_b", times.temporal_steps(gap).alias("score"))


def names_sql(col: str, kind: str) -> str:
    words = "[" + ", ".join(f"'{w}'" for w in sorted(entities.DICTIONARIES[kind])) + "]"
    return f"list_filter({words}, lambda w: contains({col}, w))"


@query("f14_dictionary_entities", check="SELECT item_id, " + ", ".join(
    f"array_to_string({names_sql(JOINED, k)}, '|') AS {k}" for k in entities.DICTIONARIES) + " FROM v_items")
def f14(t: Tables) -> DataFrame:
    body = F.concat_ws(" ", "title", "summary")
    return t.v_items.select("item_id", *[
        F.array_join(entities.known_names(body, words), "|").alias(kind)
        for kind, words in entities.DICTIONARIES.items()])


def distinct_sql(expr: str) -> str:
    """Distinct values in first-seen order."""
    return (f"list_transform(list_filter(list_transform({expr}, lambda t, i: {{'t': t, 'i': i}}), "
            f"lambda r: list_position({expr}, r.t) = r.i), lambda r: r.t)")


# RE2 knows ASCII word borders only, so the check first turns other word characters into a letter.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def found_sql(pattern: str) -> str:
    return f"regexp_extract_all(body, '{pattern}')"


DATES_SQL = (r"list_concat(list_concat(" + found_sql(r"\b\d{4}-\d{2}-\d{2}\b") + ", " + found_sql(r"\b\d{1,2}/\d{1,2}/\d{2,4}\b") + "), "
             + found_sql(rf"(?i)\b(?:{MONTHS})[a-z]* \d{{1,2}},? \d{{4}}\b") + ")")
NUMBERS_SQL = "list_filter(" + found_sql(r"\b\d+(?:\.\d+)?[MBKmbk]?\b") + ", lambda n: length(n) > 1 AND NOT starts_with(n, '0'))"
VERSIONS_SQL = found_sql(r"\bv?\d+\.\d+(?:\.\d+)?\b")


@query("f15_pattern_entities", check=rf"""WITH b AS (SELECT item_id,
  array_to_string(list_transform(string_split(title || ' ' || summary, ''), lambda c: CASE WHEN ord(c) > 127 AND regexp_matches(c, '[\p{{L}}\p{{N}}]') THEN 'z' WHEN ord(c) > 127 THEN ' ' ELSE c END), '') AS body FROM v_items)
SELECT item_id, array_to_string({distinct_sql(VERSIONS_SQL)}, '|') AS version,
 array_to_string({distinct_sql(DATES_SQL)}, '|') AS dates, array_to_string({distinct_sql(NUMBERS_SQL)}, '|') AS number FROM b""")
def f15(t: Tables) -> DataFrame:
    e = entities.extract_entities(F.col("title"), F.col("summary"))
    return t.v_items.select(
        "item_id", F.array_join(e["version"], "|").alias("version"),
        F.array_join(e["date"], "|").alias("dates"), F.array_join(e["number"], "|").alias("number"))


# No SQL check: the pattern needs Unicode word borders; tests compare it with a plain scan.
@query("f15_repository_entities")
def f15_repo(t: Tables) -> DataFrame:
    body = F.concat_ws(" ", "title", "summary")
    return t.v_items.select("item_id", F.array_join(entities.repositories(body), "|").alias("github_repo"))


@query("f17_source_novelty", check="""WITH p AS (SELECT thread_id, list(DISTINCT task_id) AS platforms FROM v_thread_items GROUP BY thread_id)
SELECT i.item_id, p.thread_id, CASE WHEN i.item_id % 13 = 0 THEN 0.5 WHEN list_contains(p.platforms, i.task_id) THEN 0.3 ELSE 1.0 END::DOUBLE AS novelty
FROM v_items i JOIN p ON p.thread_id = 't' || CAST((i.item_id + 1) % 97 AS VARCHAR)""")
def f17(t: Tables) -> DataFrame:
    platforms = t.v_thread_items.groupBy("thread_id").agg(F.collect_set("task_id").alias("platforms"))
    items = t.v_items.select(
        "item_id", F.when(F.col("item_id") % 13 != 0, F.col("task_id")).alias("source"),
        F.concat(F.lit("t"), ((F.col("item_id") + 1) % 97).cast("string")).alias("thread_id"))
    return items.join(platforms, "thread_id").select(
        "item_id", "thread_id", labels.source_novelty(F.col("source"), F.col("platforms")).alias("novelty"))


@query("f18_keyword_filter", check="""SELECT doc_id FROM documents
WHERE contains(lower(source), 'la') OR contains(lower(text), 'la') OR contains(lower(source), 'that the') OR contains(lower(text), 'that the')""")
def f18(t: Tables) -> DataFrame:
    words = F.array(F.lit(" La "), F.lit("that the"), F.lit("  "))
    return t.documents.filter(text.matches_keywords(F.col("source"), F.col("text"), words)).select("doc_id")


@query("f19_title_keywords", check=f"""WITH k AS (SELECT item_id, {tokens_sql('title')} AS toks FROM v_items_mixed)
SELECT item_id, array_to_string(list_filter(toks, lambda t: length(t) > 3)[1:5], ' ') AS keywords FROM k""")
def f19(t: Tables) -> DataFrame:
    return t.v_items_mixed.select("item_id", F.array_join(text.keywords(F.col("title")), " ").alias("keywords"))


@query("f20_strip_tags", check=r"""SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS plain FROM pages""")
def f20(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.strip_tags(F.col("html")).alias("plain"))


HTTP_SQL = "CASE regexp_extract(error_message, 'HTTP\\s+(\\d{3})', 1) " + " ".join(
    f"WHEN '{c}' THEN '{h}'" for c, h in labels.HTTP_HINTS.items()) + " WHEN '503' THEN '目标站点暂时不可用（HTTP 503），稍后会自动重试' END"


@query("f21_error_class", check=f"""SELECT execution_id,
 CASE WHEN coalesce(error_message, '') = '' THEN 'UNKNOWN' WHEN contains(lower(error_message), 'ssrf') THEN 'SSRF_BLOCKED'
  WHEN contains(lower(error_message), 'too large') THEN 'RESPONSE_TOO_LARGE'
  WHEN regexp_matches(error_message, 'HTTP\\s+\\d{{3}}') THEN 'HTTP_' || regexp_extract(error_message, 'HTTP\\s+(\\d{{3}})', 1)
  WHEN contains(lower(error_message), 'timeout') THEN 'TIMEOUT' WHEN contains(lower(error_message), 'connection') THEN 'NETWORK' ELSE 'INTERNAL' END AS error_code,
 CASE WHEN coalesce(error_message, '') = '' THEN '{labels.HINT_UNKNOWN}' WHEN contains(lower(error_message), 'ssrf') THEN '{labels.HINT_SSRF}'
  WHEN contains(lower(error_message), 'too large') THEN '{labels.HINT_LARGE}'
  WHEN regexp_matches(error_message, 'HTTP\\s+\\d{{3}}') THEN {HTTP_SQL}
  WHEN contains(lower(error_message), 'timeout') THEN '{labels.HINT_TIMEOUT}' ELSE '{labels.HINT_NETWORK}' END AS hint
FROM v_executions""")
def f21(t: Tables) -> DataFrame:
    return t.v_executions.select("execution_id", labels.classify_error(F.col("error_message")).alias("e")) \
        .select("execution_id", F.col("e.code").alias("error_code"), F.col("e.hint").alias("hint"))


RAW_TS = "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN 'bad ' || event_id ELSE NULL END"


@query("f22_iso_age", check=f"""WITH k AS (SELECT event_id, {RAW_TS} AS raw, date_trunc('second', ts) AS sec FROM events)
SELECT event_id, round(CASE WHEN event_id % 4 < 2 THEN (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(sec)) / 3600000000.0 ELSE 999.0 END, 4) AS hours FROM k""")
def f22(t: Tables) -> DataFrame:
    raw = (F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
           .when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
           .when(F.col("event_id") % 4 == 2, F.concat(F.lit("bad "), F.col("event_id").cast("string"))))
    return t.events.select("event_id", F.round(times.age_hours(times.parse_iso(raw), AS_OF), 4).alias("hours"))


@query("f23_confidence", check="""SELECT item_id, CASE WHEN similarity >= 0.7 THEN 'high' WHEN similarity >= 0.45 THEN 'medium' ELSE 'low' END AS confidence FROM v_thread_items""")
def f23(t: Tables) -> DataFrame:
    return t.v_thread_items.select("item_id", labels.confidence(F.col("similarity")).alias("confidence"))


@query("f24_lifecycle", check=f"""WITH k AS (SELECT thread_id, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_seen_at)) / 3600000000.0 AS age FROM v_threads)
SELECT thread_id, CASE WHEN age < 24 THEN 'active' WHEN age < 72 THEN 'watching' ELSE 'settled' END AS lifecycle FROM k""")
def f24(t: Tables) -> DataFrame:
    return t.v_threads.select("thread_id", times.lifecycle(F.col("last_seen_at"), AS_OF).alias("lifecycle"))


@query("f25_rfc822", check="""SELECT item_id, strftime(fetched_at, '%a, %d %b %Y %H:%M:%S +0000') AS published FROM v_items""")
def f25(t: Tables) -> DataFrame:
    return t.v_items.select("item_id", times.rfc822(F.col("fetched_at")).alias("published"))


# URLs ---------------------------------------------------------------------------------

def _url_sql(col: str) -> str:
    return rf"""(SELECT lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) || '://' || lower(regexp_extract(u, '://([^/?#]*)', 1))
 || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END FROM (
 SELECT u, regexp_replace(regexp_replace(regexp_extract(u, '://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/+$', '') AS p,
 array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(regexp_extract(u, '\?([^#]*)', 1), '&'), lambda x: x <> ''),
  lambda x, i: {{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'i': i, 'v': url_decode(replace(regexp_extract(x, '=(.*)$', 1), '+', ' '))}})),
  lambda r: replace(url_encode(r.k), '%20', '+') || '=' || replace(url_encode(r.v), '%20', '+')), '&') AS q FROM (SELECT trim({col}) AS u)))"""


@query("d01_normalize_url", check=f"SELECT page_id, {_url_sql('url')} AS normalized FROM pages")
def d01(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.normalize_url(F.col("url")).alias("normalized"))


@query("d02_url_hash", check=f"SELECT page_id, sha256({_url_sql('url')}) AS url_hash FROM pages")
def d02(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.url_hash(F.col("url")).alias("url_hash"))


HREFS_SQL = r"""SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS href FROM pages"""


@query("d03_resolve_links", check=f"""SELECT DISTINCT page_id, href,
 CASE WHEN starts_with(href, 'http') THEN href ELSE regexp_extract(url, '^(https?://[^/?#]*)', 1) || href END AS absolute FROM ({HREFS_SQL})""")
def d03(t: Tables) -> DataFrame:
    links = t.pages.select("page_id", "url", F.explode(
        F.array_distinct(F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)"'), F.lit(1)))).alias("href"))
    return links.select("page_id", "href", urls.resolve_url(F.col("url"), F.col("href")).alias("absolute"))


@query("d04_valid_url", check="""SELECT page_id, regexp_matches(url, '^(?i:https?)://[^/?#]+') AS page_ok, link,
 coalesce(regexp_matches(link, '^(?i:https?)://[^/?#]+'), false) AS link_ok FROM (SELECT p.page_id, url, link FROM pages p LEFT JOIN (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) l USING (page_id)
 UNION ALL SELECT -1 - page_id, url, NULL FROM pages)""")
def d04(t: Tables) -> DataFrame:
    # Each page also once without its html: pages without links are rows too.
    bare = t.pages.select((-1 - F.col("page_id")).alias("page_id"), "url", F.lit(None).cast("string").alias("html"))
    links = t.pages.select("page_id", "url", "html").unionByName(bare).select(
        "page_id", "url", F.explode_outer(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.select(
        "page_id", urls.is_valid_url(F.col("url")).alias("page_ok"), "link", urls.is_valid_url(F.col("link")).alias("link_ok"))


# A dictionary made from the tables: words of part names, sources, and first words of titles.
DICTIONARY_SQL = """SELECT DISTINCT entity_type, name FROM (SELECT 'part' AS entity_type, split_part(p_name, ' ', 2) AS name FROM part UNION ALL SELECT 'source', task_id FROM v_items
 UNION ALL SELECT 'title', split_part(title, ' ', 1) FROM v_items) d WHERE name <> ''"""


@query("u02_dictionary_entities", check=f"""WITH d AS MATERIALIZED (SELECT DISTINCT entity_type, lower(name) AS name FROM ({DICTIONARY_SQL})), w AS MATERIALIZED (SELECT DISTINCT name FROM d),
 k AS MATERIALIZED (SELECT item_id, lower(title || ' ' || summary) AS txt FROM v_items), h AS (SELECT item_id, name FROM k CROSS JOIN w WHERE contains(txt, name))
SELECT item_id, entity_type, array_to_string(list_sort(list(DISTINCT name)), '|') AS names FROM h JOIN d USING (name) GROUP BY item_id, entity_type""")
def u02(t: Tables) -> DataFrame:
    found = dictionary.dictionary_entities(t.v_items, t.sql(DICTIONARY_SQL))
    return found.withColumn("names", F.array_join("names", "|"))


NEAREST_SQL = """WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, x.vec_id AS id, round(greatest(0.0, least(1.0, list_dot_product(q.v, x.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(x.v, x.v))))), 9) AS similarity
  FROM u q JOIN u x ON q.vec_id <> x.vec_id)
SELECT query_id, id, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 10"""


def _nearest(t: Tables, probes: int | None) -> DataFrame:
    """The ten nearest others of every vector."""
    units = vectors.unit_vectors(t.embeddings, "vec_id", "embedding")
    return vectors.nearest(units, units, 10, probes=probes).withColumn("similarity", F.round("similarity", 6))


@query("u01_nearest_vectors_exact", check=NEAREST_SQL)
def u01_exact(t: Tables) -> DataFrame:
    return _nearest(t, None)


@query("u01_nearest_vectors", check=NEAREST_SQL)
def u01(t: Tables) -> DataFrame:
    """By cells, the nearest first, and none left out."""
    return _nearest(t, vectors.CELLS)
