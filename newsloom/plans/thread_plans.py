"""Queries over threads: hotness, roll-up, profile, relations, merge, split, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.threads import edit, hotness, relations, rollup
from newsloom.plans.fixtures import AS_OF, Tables
from newsloom.plans.registry import query

NOW = f"TIMESTAMP '{AS_OF}'"


def heat_sql(ts: str, at: str) -> str:
    age = f"(epoch_us({at}) - epoch_us({ts})) / 3600000000.0"
    return f"CASE WHEN {age} <= 48 THEN pow(2.0, -greatest({age}, 0.0) / 24) ELSE 0.0 END"


MOMENTUM_SQL = f"""ps AS (SELECT thread_id, task_id, max(fetched_at) AS latest, max(CASE WHEN fetched_at <= {NOW} - INTERVAL 24 HOUR THEN fetched_at END) AS latest_then FROM v_thread_items GROUP BY ALL),
 mo AS (SELECT thread_id, round(sum(coalesce({heat_sql('latest', NOW)}, 0)), 4) AS hotness, round(sum(coalesce({heat_sql('latest_then', f'({NOW} - INTERVAL 24 HOUR)')}, 0)), 4) AS previous FROM ps GROUP BY thread_id)"""
BOTH_SQL = """bd AS (SELECT thread_a AS thread_id, thread_b AS other_id, similarity, source FROM v_relations UNION ALL SELECT thread_b, thread_a, similarity, source FROM v_relations)"""
SUMMARY_SQL = f"""{BOTH_SQL}, rs AS (SELECT thread_id, count(*) AS related_count, max(similarity) AS related_similarity, arg_min(other_id, {{'s': -similarity, 'o': other_id}}) AS related_top FROM bd GROUP BY thread_id)"""


@query("t17_hotness", check=f"WITH {MOMENTUM_SQL} SELECT thread_id, hotness FROM mo")
def t17(t: Tables) -> DataFrame:
    return hotness.hotness(t.v_thread_items, AS_OF)


@query("t18_momentum", check=f"WITH {MOMENTUM_SQL} SELECT thread_id, hotness, previous, round(hotness - previous, 4) AS delta FROM mo")
def t18(t: Tables) -> DataFrame:
    return hotness.momentum(t.v_thread_items, AS_OF)


@query("t09_thread_rollup", check="""SELECT thread_id, count(*) AS item_count, array_to_string(list_sort(list(DISTINCT k.name)), '|') AS platforms,
 arg_max(title, {'l': length(title), 't': -epoch_us(fetched_at), 'i': -item_id}) AS title, min(fetched_at) AS first_seen_at, max(fetched_at) AS last_seen_at
FROM v_thread_items JOIN v_tasks k USING (task_id) GROUP BY thread_id""")
def t09(t: Tables) -> DataFrame:
    repeated = t.v_thread_items.unionByName(t.v_thread_items.filter("similarity > 0.5"))
    return rollup.roll_up(repeated, t.v_tasks).withColumn("platforms", F.array_join("platforms", "|"))


MERGES_SQL = "SELECT thread_b AS thread_id, min(thread_a) AS target_id FROM v_relations WHERE similarity >= 0.3 GROUP BY thread_b"
CHAIN_SQL = f"""m AS ({MERGES_SQL}), walk AS (SELECT thread_id, target_id, 1 AS depth FROM m UNION ALL SELECT w.thread_id, m.target_id, depth + 1 FROM walk w JOIN m ON m.thread_id = w.target_id),
 fin AS (SELECT thread_id, arg_max(target_id, depth) AS target_id FROM walk GROUP BY thread_id)"""


@query("t10_merge_members", check=f"""WITH RECURSIVE {CHAIN_SQL}
SELECT coalesce(target_id, i.thread_id) AS thread_id, item_id, CASE WHEN target_id IS NULL THEN similarity ELSE 1.0 END::DOUBLE AS similarity FROM v_thread_items i LEFT JOIN fin USING (thread_id)""")
def t10_members(t: Tables) -> DataFrame:
    return edit.merge_threads(t.v_thread_items, t.v_relations, t.sql(MERGES_SQL))[0].select("thread_id", "item_id", "similarity")


# Thread rows after an edit, from the members it left.
REBUILT_SQL = """SELECT thread_id, count(*) AS item_count, array_to_string(list_sort(list(DISTINCT task_id)), ', ') AS platforms,
 arg_max(title, {'l': length(title), 't': -epoch_us(fetched_at), 'i': -item_id}) AS title, min(fetched_at) AS first_seen_at, max(fetched_at) AS last_seen_at FROM mb GROUP BY thread_id"""


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("thread_id", "item_count", F.array_join("platforms", ", ").alias("platforms"), "title", "first_seen_at", "last_seen_at")


@query("t10_merged_threads", check=f"""WITH RECURSIVE {CHAIN_SQL}, mb AS (SELECT DISTINCT coalesce(target_id, i.thread_id) AS thread_id, item_id, task_id, title, fetched_at FROM v_thread_items i LEFT JOIN fin USING (thread_id))
{REBUILT_SQL}""")
def t10_threads(t: Tables) -> DataFrame:
    return shown(edit.rebuilt_threads(edit.merge_threads(t.v_thread_items, t.v_relations, t.sql(MERGES_SQL))[0]))


@query("t10_merge_relations", check=f"""WITH RECURSIVE {CHAIN_SQL},
 r AS (SELECT coalesce(fa.target_id, r.thread_a) AS a, coalesce(fb.target_id, r.thread_b) AS b, similarity, source, fa.target_id IS NOT NULL OR fb.target_id IS NOT NULL AS moved, r.thread_a AS oa, r.thread_b AS ob
  FROM v_relations r LEFT JOIN fin fa ON fa.thread_id = r.thread_a LEFT JOIN fin fb ON fb.thread_id = r.thread_b)
SELECT least(a, b) AS thread_a, greatest(a, b) AS thread_b, max(similarity) AS similarity, arg_min(source, {{'m': moved, 'a': oa, 'b': ob}}) AS source FROM r WHERE a <> b GROUP BY 1, 2""")
def t10_relations(t: Tables) -> DataFrame:
    return edit.merge_threads(t.v_thread_items, t.v_relations, t.sql(MERGES_SQL))[1]


# Items that match their thread badly move out; threads where all would move stay whole.
MOVES_SQL = "SELECT thread_id, item_id, thread_id || '-s' AS new_thread_id, CASE WHEN thread_id < 't5' THEN 'Split of ' || thread_id END AS new_title FROM v_thread_items WHERE similarity < 0.4"
SPLIT_SQL = f"""mv AS ({MOVES_SQL}), n AS (SELECT i.thread_id, count(*) AS n_all, count(mv.item_id) AS n_moved FROM v_thread_items i LEFT JOIN mv USING (thread_id, item_id) GROUP BY 1),
 ok AS (SELECT mv.*, i.similarity, i.title FROM mv JOIN v_thread_items i USING (thread_id, item_id) JOIN n USING (thread_id) WHERE n_moved < n_all)"""


@query("t11_split_members", check=f"""WITH {SPLIT_SQL}
SELECT coalesce(ok.new_thread_id, i.thread_id) AS thread_id, i.item_id, CASE WHEN ok.item_id IS NULL THEN i.similarity ELSE 1.0 END::DOUBLE AS similarity
FROM v_thread_items i LEFT JOIN ok USING (thread_id, item_id)""")
def t11_members(t: Tables) -> DataFrame:
    return edit.split_threads(t.v_thread_items, t.v_relations, t.sql(MOVES_SQL))[0].select("thread_id", "item_id", "similarity")


@query("t11_split_threads", check=f"""WITH {SPLIT_SQL}, mb AS (SELECT coalesce(ok.new_thread_id, i.thread_id) AS thread_id, i.item_id, task_id, i.title, fetched_at FROM v_thread_items i LEFT JOIN ok USING (thread_id, item_id)),
 g AS (SELECT new_thread_id AS thread_id, coalesce(max(new_title), arg_min(title, item_id)) AS given FROM ok GROUP BY new_thread_id), r AS ({REBUILT_SQL})
SELECT r.* REPLACE (coalesce(given, title) AS title) FROM r LEFT JOIN g USING (thread_id)""")
def t11_threads(t: Tables) -> DataFrame:
    members, _, titles = edit.split_threads(t.v_thread_items, t.v_relations, t.sql(MOVES_SQL))
    return shown(edit.rebuilt_threads(members, titles=titles))


@query("t11_split_relations", check=f"""WITH {SPLIT_SQL}
SELECT thread_a, thread_b, round(similarity, 6) AS similarity, source FROM v_relations
UNION ALL SELECT least(thread_id, new_thread_id), greatest(thread_id, new_thread_id), round(avg(similarity), 6), 'split' FROM ok GROUP BY thread_id, new_thread_id""")
def t11_relations(t: Tables) -> DataFrame:
    links = edit.split_threads(t.v_thread_items, t.v_relations, t.sql(MOVES_SQL))[1]
    return links.withColumn("similarity", F.round("similarity", 6))


@query("t11_split_titles", check=f"""WITH {SPLIT_SQL} SELECT new_thread_id AS thread_id, coalesce(max(new_title), arg_min(title, item_id)) AS title FROM ok GROUP BY new_thread_id""")
def t11_titles(t: Tables) -> DataFrame:
    return edit.split_threads(t.v_thread_items, t.v_relations, t.sql(MOVES_SQL))[2]


LOG_SQL = """SELECT 't' || CAST(item_id % 97 AS STRING) AS thread_a, 't' || CAST((item_id * 31 + 5) % 97 AS STRING) AS thread_b, CAST((item_id * 13) % 35 AS DOUBLE) / 100 AS similarity,
 CASE WHEN item_id % 10 = 0 THEN 'split' ELSE 'auto' END AS source, item_id AS seq FROM v_items"""


@query("t12_record_relations", check=f"""WITH l AS (SELECT least(thread_a, thread_b) AS a, greatest(thread_a, thread_b) AS b, similarity, source, seq FROM ({LOG_SQL}) WHERE thread_a <> thread_b)
SELECT a AS thread_a, b AS thread_b, arg_min(similarity, seq) AS similarity, arg_min(source, seq) AS source FROM l
WHERE source = 'split' OR NOT EXISTS (SELECT 1 FROM v_overrides o WHERE least(o.thread_id, o.target_thread_id) = a AND greatest(o.thread_id, o.target_thread_id) = b) GROUP BY a, b""")
def t12(t: Tables) -> DataFrame:
    return relations.record_relations(t.sql(LOG_SQL), t.v_overrides)


@query("t13_related_threads", check=f"WITH {BOTH_SQL} SELECT bd.thread_id, other_id, h.title AS other_title, similarity, source FROM bd JOIN v_threads h ON h.thread_id = bd.other_id")
def t13(t: Tables) -> DataFrame:
    return relations.related_threads(t.v_relations, t.v_threads)


@query("t14_relation_summary", check=f"WITH {SUMMARY_SQL} SELECT rs.*, h.title AS related_title FROM rs LEFT JOIN v_threads h ON h.thread_id = rs.related_top")
def t14(t: Tables) -> DataFrame:
    return relations.relation_summary(t.v_relations, t.v_threads)


UNLINK_SQL = "SELECT thread_b AS thread_a, thread_a AS thread_b FROM v_relations WHERE similarity < 0.05"


@query("t15_unlink", check="""SELECT 'relation' AS kind, thread_a, thread_b FROM v_relations WHERE NOT similarity < 0.05
UNION ALL SELECT 'override', thread_id, target_thread_id FROM v_overrides UNION ALL SELECT 'override', thread_a, thread_b FROM v_relations WHERE similarity < 0.05""")
def t15(t: Tables) -> DataFrame:
    left, noted = relations.unlink(t.v_relations, t.v_overrides, t.sql(UNLINK_SQL))
    return left.select(F.lit("relation").alias("kind"), "thread_a", "thread_b").unionByName(
        noted.select(F.lit("override").alias("kind"), F.col("thread_id").alias("thread_a"), F.col("target_thread_id").alias("thread_b")))


@query("t16_override_audit", check="""SELECT thread_id, target_thread_id, override_type, h.last_seen_at AS created_at FROM v_overrides JOIN v_threads h USING (thread_id)
ORDER BY created_at DESC, thread_id, target_thread_id LIMIT 50""")
def t16(t: Tables) -> DataFrame:
    dated = t.v_overrides.join(t.v_threads.select("thread_id", F.col("last_seen_at").alias("created_at")), "thread_id")
    return relations.override_audit(dated)


SEED_SQL = """sd AS (SELECT *, CASE WHEN bool_or(match_reason = 'initial_item') OVER (PARTITION BY thread_id) THEN match_reason = 'initial_item'
  ELSE row_number() OVER (PARTITION BY thread_id ORDER BY fetched_at NULLS LAST, item_id) = 1 END AS is_seed FROM v_thread_items)"""


@query("t19_thread_profile", check=f"""WITH {SEED_SQL}, nm AS (SELECT sd.*, k.name AS platform FROM sd JOIN v_tasks k USING (task_id)),
 b AS (SELECT thread_id, platform, count(*) AS n, max(fetched_at) AS last FROM nm GROUP BY ALL),
 bb AS (SELECT thread_id, string_agg(platform || ':' || n, '|' ORDER BY n DESC, platform) AS breakdown, count(*) AS platform_count, round(sum({heat_sql('last', NOW)}), 4) AS hotness FROM b GROUP BY thread_id),
 a AS (SELECT thread_id, count(*) AS item_count, count(*) FILTER (WHERE fetched_at >= {NOW} - INTERVAL 6 HOUR) AS recent_6h_count, count(*) FILTER (WHERE fetched_at >= {NOW} - INTERVAL 24 HOUR) AS recent_24h_count,
  round((epoch_us(max(fetched_at)) - epoch_us(min(fetched_at))) / 3600000000.0, 1) AS span_hours, count(*) FILTER (WHERE NOT is_seed) AS matched_item_count,
  round(avg(similarity) FILTER (WHERE NOT is_seed), 4) AS similarity_avg, round(max(similarity) FILTER (WHERE NOT is_seed), 4) AS similarity_max FROM nm GROUP BY thread_id)
SELECT a.*, platform_count, breakdown, hotness, platform_count > 1 AS is_cross_platform,
 CASE WHEN similarity_avg >= 0.7 THEN 'high' WHEN similarity_avg >= 0.45 THEN 'medium' WHEN similarity_avg IS NOT NULL THEN 'low' END AS confidence FROM a JOIN bb USING (thread_id)""")
def t19(t: Tables) -> DataFrame:
    made = rollup.profile(t.v_thread_items, t.v_tasks, AS_OF)
    text = F.array_join(F.transform("platform_breakdown", lambda p: F.concat_ws(":", p["platform"], p["count"].cast("string"))), "|")
    return made.withColumn("breakdown", text).drop("platform_breakdown")


@query("t20_seed_items", check=f"WITH {SEED_SQL} SELECT thread_id, item_id FROM sd WHERE is_seed")
def t20(t: Tables) -> DataFrame:
    return rollup.seeds(t.v_thread_items).filter("is_seed").select("thread_id", "item_id")


LIST_SQL = f"""WITH {MOMENTUM_SQL}, {SUMMARY_SQL}
SELECT h.thread_id, h.title, h.first_seen_at, h.last_seen_at, h.item_count, hotness, previous, round(hotness - previous, 4) AS delta, coalesce(related_count, 0) AS related_count, related_top, related_similarity,
 x.title AS related_title, (SELECT count(*) FROM v_threads) AS total FROM v_threads h JOIN mo USING (thread_id) LEFT JOIN rs USING (thread_id) LEFT JOIN v_threads x ON x.thread_id = rs.related_top"""


@query("t21_thread_list_by_hotness", check=f"{LIST_SQL} ORDER BY hotness DESC, h.last_seen_at DESC, h.thread_id DESC LIMIT 20 OFFSET 20")
def t21(t: Tables) -> DataFrame:
    return rollup.thread_list(t.v_threads, t.v_thread_items, t.v_relations, AS_OF, sort="hotness", page=2)


@query("t21_thread_list_by_first_seen", check=f"{LIST_SQL} ORDER BY h.first_seen_at DESC, h.thread_id DESC LIMIT 20")
def t21_first(t: Tables) -> DataFrame:
    return rollup.thread_list(t.v_threads, t.v_thread_items, t.v_relations, AS_OF)


@query("t22_timeline", check="""SELECT thread_id, item_id, title, k.name AS task_name, fetched_at, similarity, match_reason FROM v_thread_items JOIN v_tasks k USING (task_id)""")
def t22(t: Tables) -> DataFrame:
    return rollup.timeline(t.v_thread_items, t.v_tasks)


@query("t23_delete_cascade", check="""WITH gone AS (SELECT item_id FROM v_items WHERE is_read AND created_at < TIMESTAMP '2024-01-10 00:00:00')
SELECT thread_id, count(*) AS item_count, arg_max(title, {'l': length(title), 't': -epoch_us(fetched_at), 'i': -item_id}) AS title, max(fetched_at) AS last_seen_at FROM v_thread_items WHERE item_id NOT IN (SELECT item_id FROM gone) GROUP BY thread_id""")
def t23(t: Tables) -> DataFrame:
    gone = t.v_items.filter("is_read AND created_at < TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    _, threads, _ = rollup.drop_items(t.v_thread_items, t.v_interactions, gone)
    return threads.select("thread_id", "item_count", "title", "last_seen_at")


@query("t23_orphan_interactions", check="""SELECT interaction_id, item_id FROM v_interactions WHERE item_id NOT IN (SELECT item_id FROM v_items WHERE is_read AND created_at < TIMESTAMP '2024-01-10 00:00:00')""")
def t23_interactions(t: Tables) -> DataFrame:
    gone = t.v_items.filter("is_read AND created_at < TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    _, _, kept = rollup.drop_items(t.v_thread_items, t.v_interactions, gone)
    return kept.select("interaction_id", "item_id")


@query("t24_digest_prompts", check=rf"""WITH top AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY fetched_at DESC, item_id DESC) AS n FROM v_thread_items),
 l AS (SELECT top.thread_id, n, n || '. [' || k.name || '] ' || regexp_replace(top.title, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') ||
   CASE WHEN trim(i.summary) <> '' THEN chr(10) || '{rollup.PROMPT_SUMMARY}' || left(regexp_replace(i.summary, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), 300) ELSE '' END AS line
  FROM top JOIN v_items i USING (item_id) JOIN v_tasks k ON k.task_id = top.task_id WHERE n <= 10)
SELECT h.thread_id, '{rollup.PROMPT_TITLE}' || max(h.title) || chr(10) || chr(10) || '{rollup.PROMPT_MATERIAL}' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS prompt
FROM l JOIN v_threads h USING (thread_id) WHERE h.item_count >= 2 AND h.thread_id NOT IN (SELECT thread_a FROM v_relations WHERE similarity = 0) GROUP BY h.thread_id""")
def t24(t: Tables) -> DataFrame:
    done = t.v_relations.filter("similarity = 0").select(F.col("thread_a").alias("thread_id"), F.lit("done").alias("digest"))
    return rollup.digest_prompts(t.v_threads, t.v_thread_items, t.v_items, t.v_tasks, done)
