"""Queries over personalisation, labels and ranking evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import evaluate, recommend
from newsloom.plans.fixtures import AS_OF, Tables
from newsloom.plans.registry import query
from newsloom.plans.text_plans import token_set_sql, tokens_sql

NOW = f"TIMESTAMP '{AS_OF}'"


TEXT_SQL = "title || ' ' || summary"


def hits_sql(items: str) -> str:
    """Matches of every item with every distinct topic, and their sums per reader."""
    return f"""tw AS MATERIALIZED (SELECT DISTINCT topic, lower(topic) AS low, {token_set_sql('topic')} AS ttoks FROM v_reader_topics),
 tk AS MATERIALIZED (SELECT item_id, lower({TEXT_SQL}) AS txt, lower(title) AS tit, lower(summary) AS sm, {token_set_sql(TEXT_SQL)} AS toks FROM {items}),
 th AS MATERIALIZED (SELECT item_id, topic, CASE WHEN len(toks) = 0 THEN 0 WHEN contains(txt, low) THEN 1.0 WHEN list_has_any(ttoks, toks) THEN 0.5 ELSE 0 END AS strength,
  contains(tit, trim(low)) OR contains(sm, trim(low)) AS named FROM tk CROSS JOIN tw),
 tt AS (SELECT user_id, sum(weight) AS total FROM v_reader_topics GROUP BY user_id),
 tp AS (SELECT user_id, item_id, sum(weight * strength) / any_value(total) AS s, arg_min(topic, {{'w': -weight, 't': topic}}) FILTER (WHERE named) AS matched_topic
  FROM th JOIN v_reader_topics USING (topic) JOIN tt USING (user_id) WHERE strength > 0 OR named GROUP BY user_id, item_id)"""


@query("r01_topic_score", check=f"WITH {hits_sql('v_items')} SELECT user_id, item_id, round(s, 6) AS topic_score, matched_topic FROM tp")
def r01(t: Tables) -> DataFrame:
    return recommend.topic_scores(t.v_items, t.v_reader_topics).withColumn("topic_score", F.round("topic_score", 6))


ENGAGED_SQL = """en AS (SELECT item_id, count(*) AS total_interactions, count(*) FILTER (WHERE interaction_type IN ('view', 'impression')) AS view_count, count(*) FILTER (WHERE interaction_type = 'dwell') AS dwell_count,
 count(*) FILTER (WHERE interaction_type = 'star') AS star_count, count(*) FILTER (WHERE interaction_type IN ('click', 'click_source')) AS click_count, avg(coalesce(dwell_seconds, 0)) AS avg_dwell_seconds FROM v_interactions GROUP BY item_id)"""


@query("r02_engagement", check=f"WITH {ENGAGED_SQL} SELECT * REPLACE (round(avg_dwell_seconds, 6) AS avg_dwell_seconds) FROM en")
def r02(t: Tables) -> DataFrame:
    return recommend.engagement(t.v_interactions).withColumn("avg_dwell_seconds", F.round("avg_dwell_seconds", 6))


@query("r03_engagement_score", check=f"WITH {ENGAGED_SQL} SELECT item_id, round(CASE WHEN view_count > 0 THEN (least(1.0, view_count / 3) + least(1.0, avg_dwell_seconds / 30)) / 2 ELSE 0 END, 6) AS engagement_score FROM en")
def r03(t: Tables) -> DataFrame:
    stats = recommend.engagement(t.v_interactions)
    return stats.select("item_id", F.round(recommend.engagement_score(F.col("view_count"), F.col("avg_dwell_seconds")), 6).alias("engagement_score"))


RECENCY_SQL = f"CASE WHEN (epoch_us({NOW}) - epoch_us(fetched_at)) / 3600000000.0 <= 24 THEN 1.0 ELSE pow(0.5, ((epoch_us({NOW}) - epoch_us(fetched_at)) / 3600000000.0 - 24) / 6) END"


@query("r04_recency", check=f"SELECT item_id, round({RECENCY_SQL}, 6) AS recency_score FROM v_items")
def r04(t: Tables) -> DataFrame:
    from newsloom.functions.times import recency
    return t.v_items.select("item_id", F.round(recency(F.col("fetched_at"), AS_OF), 6).alias("recency_score"))


DELTA_SQL = f"""ix AS (SELECT n.*, i.task_id, k.name, {tokens_sql('i.title')} AS toks FROM v_interactions n JOIN v_items i USING (item_id) LEFT JOIN v_tasks k USING (task_id)),
 dl AS (SELECT interaction_id, user_id, created_at, 'task' AS affinity_type, task_id AS affinity_value, CASE WHEN interaction_type = 'star' THEN 0.1 ELSE 0.05 END::DOUBLE AS delta FROM ix WHERE interaction_type IN ('view', 'click', 'dwell', 'star')
  UNION ALL SELECT interaction_id, user_id, created_at, 'platform', name, CASE WHEN interaction_type = 'star' THEN 0.08 ELSE 0.03 END FROM ix WHERE interaction_type IN ('view', 'click', 'dwell', 'star')
  UNION ALL SELECT interaction_id, user_id, created_at, 'keyword', unnest(list_filter(toks, lambda w: length(w) > 3)[1:3]), 0.02 FROM ix WHERE interaction_type IN ('view', 'dwell') AND dwell_seconds > 10)"""


@query("r06_affinity_deltas", check=f"WITH {DELTA_SQL} SELECT interaction_id, user_id, affinity_type, affinity_value, delta FROM dl")
def r06(t: Tables) -> DataFrame:
    return recommend.affinity_deltas(t.v_interactions, t.v_items, t.v_tasks).select(
        "interaction_id", "user_id", "affinity_type", "affinity_value", "delta")


def fold_sql(keys: str) -> str:
    """Sequential fold, one update per step."""
    on = " AND ".join(f"f.{k} = o.{k}" for k in keys.split(", "))
    cols = ", ".join(f"o.{k}" for k in keys.split(", "))
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY created_at, interaction_id) AS n FROM dl),
 f AS (SELECT {keys}, n, delta AS s, created_at FROM o WHERE n = 1 UNION ALL
  SELECT {cols}, o.n, least(1.0, greatest(0.0, 0.9 * f.s + 0.1 * o.delta)), o.created_at FROM f JOIN o ON {on} AND o.n = f.n + 1),
 af AS (SELECT {keys}, arg_max(s, n) AS affinity_score, max(n) AS interaction_count, max(created_at) AS last_interacted_at FROM f GROUP BY ALL)"""


@query("r05_affinity_fold", check=f"""WITH RECURSIVE {DELTA_SQL}, {fold_sql('user_id, affinity_type, affinity_value')}
SELECT user_id, affinity_type, affinity_value, round(affinity_score + 1e-9, 6) AS affinity_score, interaction_count, last_interacted_at FROM af""")
def r05(t: Tables) -> DataFrame:
    deltas = recommend.affinity_deltas(t.v_interactions, t.v_items, t.v_tasks)
    return recommend.fold_affinity(deltas, by=["user_id"]).withColumn("affinity_score", F.round(F.col("affinity_score") + 1e-9, 6))


# The nudge keeps exact decimal halves from rounding differently in the two engines.
NUDGE = 1e-12
READER_SQL = f"""{DELTA_SQL}, {fold_sql('user_id, affinity_type, affinity_value')}, a9 AS MATERIALIZED (SELECT * REPLACE (round(affinity_score + 1e-12, 9) AS affinity_score) FROM af),
 rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY affinity_score DESC, affinity_type, affinity_value) AS rank FROM a9)"""


def affinity_by_reader(t: Tables) -> DataFrame:
    folded = recommend.fold_affinity(recommend.affinity_deltas(t.v_interactions, t.v_items, t.v_tasks), by=["user_id"])
    return folded.withColumn("affinity_score", F.round(F.col("affinity_score") + NUDGE, 9))


def component_sql(factor: int) -> str:
    ranked = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY affinity_score DESC, affinity_value) AS r FROM a9 WHERE affinity_type = "
    return f"""cm AS MATERIALIZED (SELECT user_id, task_id, sum(part) AS affinity_score FROM (
  SELECT user_id, affinity_value AS task_id, 0.6 * affinity_score * {factor} AS part FROM ({ranked} 'task') WHERE r <= 50 AND affinity_score * {factor} > 0.3
  UNION ALL SELECT user_id, k.task_id, 0.4 * affinity_score * {factor} FROM ({ranked} 'platform') p JOIN v_tasks k ON k.name = p.affinity_value WHERE r <= 20) GROUP BY user_id, task_id)"""


# Five times stronger than the deltas make them, so that the gate of tasks lets some through.
@query("r07_affinity_component", check=f"WITH RECURSIVE {READER_SQL}, {component_sql(5)} SELECT user_id, task_id, round(affinity_score, 6) AS affinity_score FROM cm")
def r07(t: Tables) -> DataFrame:
    strong = affinity_by_reader(t).withColumn("affinity_score", F.col("affinity_score") * 5)
    return recommend.affinity_component(t.v_tasks, strong).withColumn("affinity_score", F.round("affinity_score", 6))


FACTOR_SQL = f"""{READER_SQL}, {component_sql(1)}, {ENGAGED_SQL.replace("en AS (SELECT item_id,", "en AS (SELECT user_id, item_id,").replace("GROUP BY item_id", "GROUP BY user_id, item_id")},
 pool AS MATERIALIZED (SELECT * FROM (SELECT * FROM v_items WHERE created_at >= {NOW} - INTERVAL 7 DAY ORDER BY created_at DESC, item_id DESC LIMIT 500) WHERE NOT is_read),
 {hits_sql('pool')}, rd AS (SELECT user_id FROM a9 UNION SELECT user_id FROM v_reader_topics),
 fx AS MATERIALIZED (SELECT rd.user_id, p.item_id, p.created_at, k.name AS task_name, matched_topic, coalesce(tp.s, 0) AS topic_score, coalesce(cm.affinity_score, 0) AS affinity_score,
  {RECENCY_SQL} AS recency_score, CASE WHEN en.view_count > 0 THEN (least(1.0, en.view_count / 3) + least(1.0, en.avg_dwell_seconds / 30)) / 2 ELSE 0 END AS engagement_score
  FROM rd CROSS JOIN pool p LEFT JOIN v_tasks k USING (task_id) LEFT JOIN tp ON tp.user_id = rd.user_id AND tp.item_id = p.item_id
  LEFT JOIN en ON en.user_id = rd.user_id AND en.item_id = p.item_id LEFT JOIN cm ON cm.user_id = rd.user_id AND cm.task_id = p.task_id)"""
SCORED_SQL = """sc AS (SELECT *, round(least(1.0, 0.4 * topic_score + 0.3 * affinity_score + 0.2 * recency_score + 0.1 * engagement_score), 9) AS score FROM fx)"""


def factors(t: Tables) -> DataFrame:
    return recommend.score_factors(t.v_items, t.v_tasks, t.v_reader_topics, affinity_by_reader(t), t.v_interactions, AS_OF)


@query("r08_recommendations", check=f"""WITH RECURSIVE {FACTOR_SQL}, {SCORED_SQL}
SELECT user_id, item_id, task_name, round(topic_score, 4) AS topic_score, round(affinity_score, 4) AS affinity_score, round(recency_score, 4) AS recency_score, round(engagement_score, 4) AS engagement_score, round(score, 4) AS recommendation_score
FROM sc WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, created_at DESC, item_id DESC) <= 20""")
def r08(t: Tables) -> DataFrame:
    top = recommend.recommend(factors(t))
    return top.select("user_id", "item_id", "task_name", *[F.round(f, 4).alias(f) for f in recommend.FACTORS], "recommendation_score")


@query("r09_reasons", check=f"""WITH RECURSIVE {FACTOR_SQL}, {SCORED_SQL}
SELECT user_id, item_id, array_to_string(list_filter([CASE WHEN topic_score > 0.3 THEN CASE WHEN matched_topic IS NULL THEN '{recommend.LABEL_ANY_TOPIC}' ELSE '匹配你的兴趣「' || matched_topic || '」' END END,
 CASE WHEN affinity_score > 0.05 THEN '{recommend.LABEL_AFFINITY}' || task_name END, CASE WHEN recency_score > 0.8 THEN '{recommend.LABEL_RECENCY}' END, CASE WHEN engagement_score > 0.5 THEN '{recommend.LABEL_ENGAGEMENT}' END], lambda r: r IS NOT NULL), '; ') AS reasons
FROM sc WHERE score >= 0.1""")
def r09(t: Tables) -> DataFrame:
    scored = recommend.score_candidates(factors(t))
    return scored.select("user_id", "item_id", F.array_join(F.transform("reasons", lambda r: r["label"]), "; ").alias("reasons"))


@query("r10_reading_profile", check=f"""WITH RECURSIVE {READER_SQL}, g AS (SELECT user_id, CASE WHEN affinity_type IN ('task', 'platform') THEN 'task' ELSE affinity_type END AS display_type,
 CASE WHEN affinity_type = 'task' THEN coalesce(k.name, '{recommend.DELETED_TASK}') ELSE affinity_value END AS display_value,
 round(sum(affinity_score), 6) AS affinity_score, max(interaction_count) AS interaction_count, max(last_interacted_at) AS last_interacted_at
FROM rk LEFT JOIN v_tasks k ON k.task_id = rk.affinity_value AND k.deleted_at IS NULL WHERE rank <= 50 GROUP BY 1, 2, 3) SELECT * FROM g""")
def r10(t: Tables) -> DataFrame:
    live = t.v_tasks.filter("deleted_at IS NULL")
    return recommend.reading_profile(affinity_by_reader(t), live).withColumn("affinity_score", F.round("affinity_score", 6))


@query("r11_suggested_topics", check=f"""WITH RECURSIVE {READER_SQL}, top AS (SELECT * FROM rk WHERE rank <= 20),
 w AS (SELECT user_id, unnest(list_filter({token_set_sql('affinity_value')}, lambda t: length(t) > 2)) AS topic, 'task' AS k, affinity_score FROM top WHERE affinity_type = 'task' UNION ALL SELECT user_id, affinity_value, 'keyword', affinity_score FROM top WHERE affinity_type = 'keyword'),
 b AS (SELECT user_id, topic, arg_max(CASE WHEN k = 'task' AND regexp_matches(topic, 'ai|ml|gpt|llm') THEN 'ai' ELSE 'custom' END, {{'s': affinity_score, 'k': k}}) AS category, round(max(affinity_score), 2) AS score FROM w GROUP BY user_id, topic)
SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, topic) <= 10""")
def r11(t: Tables) -> DataFrame:
    return recommend.suggested_topics(affinity_by_reader(t))


@query("r12_recent_interactions", check=f"""SELECT interaction_id, user_id, item_id, created_at FROM v_interactions WHERE interaction_type = 'star' AND created_at >= {NOW} - INTERVAL 72 HOUR ORDER BY created_at DESC, interaction_id DESC LIMIT 100""")
def r12(t: Tables) -> DataFrame:
    return recommend.recent_interactions(t.v_interactions, AS_OF, 72, "star").select("interaction_id", "user_id", "item_id", "created_at")


def feedback(t: Tables) -> DataFrame:
    return t.v_interactions.filter("interaction_type = 'not_interested'").select(
        F.col("interaction_type").alias("feedback_type"), F.col("item_id").alias("target"))


@query("r13_negative_feedback", check="""SELECT 'not_interested' AS feedback_type, item_id AS target, count(*) AS times FROM v_interactions WHERE interaction_type = 'not_interested' GROUP BY item_id""")
def r13(t: Tables) -> DataFrame:
    return recommend.negative_feedback(feedback(t))


@query("r13_without_rejected", check="""SELECT item_id FROM v_items WHERE item_id NOT IN (SELECT item_id FROM v_interactions WHERE interaction_type = 'not_interested')""")
def r13_filter(t: Tables) -> DataFrame:
    return recommend.without_rejected(t.v_items, feedback(t)).select("item_id")


@query("r14_label_sample", check=f"""WITH RECURSIVE {FACTOR_SQL}, {SCORED_SQL}, u AS (SELECT user_id, item_id, created_at, round(score, 4) AS recommendation_score FROM sc WHERE score >= 0.1 AND item_id NOT IN (SELECT item_id FROM v_labels)),
 k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY recommendation_score DESC, created_at DESC, item_id DESC) - 1 AS r, greatest(1, CAST(floor(count(*) OVER (PARTITION BY user_id) / 20) AS BIGINT)) AS step FROM u)
SELECT user_id, item_id, recommendation_score, CAST(r // step AS INT) AS sample_position FROM k WHERE r % step = 0 AND r // step < 20""")
def r14(t: Tables) -> DataFrame:
    scored = recommend.score_candidates(factors(t))
    return recommend.sample_for_labeling(scored, t.v_labels).select("user_id", "item_id", "recommendation_score", "sample_position")


LABEL_LOG_SQL = """SELECT item_id, CASE WHEN interaction_type = 'star' THEN 1 ELSE 0 END AS label, CASE WHEN interaction_id % 3 = 0 THEN NULL ELSE CAST(interaction_id % 101 AS DOUBLE) / 100 END AS sampled_score,
 created_at AS at, interaction_id AS seq FROM v_interactions WHERE interaction_type IN ('star', 'not_interested')"""


@query("r15_label_upsert", check=f"""WITH l AS ({LABEL_LOG_SQL.replace(' AS at,', ' AS at_,')})
SELECT item_id, arg_max(label, {{'t': at_, 's': seq}}) AS label, arg_max(sampled_score, {{'t': at_, 's': seq}}) FILTER (WHERE sampled_score IS NOT NULL) AS sampled_score, max(at_) AS labeled_at FROM l GROUP BY item_id""")
def r15(t: Tables) -> DataFrame:
    return recommend.upsert_labels(t.sql(LABEL_LOG_SQL))


WIN_SQL = """w AS (SELECT sum(CASE WHEN p.sampled_score > n.sampled_score THEN 1.0 WHEN p.sampled_score = n.sampled_score THEN 0.5 ELSE 0 END) / count(*) AS rate
 FROM v_labels p JOIN v_labels n ON p.label = 1 AND n.label = 0 AND p.sampled_score IS NOT NULL AND n.sampled_score IS NOT NULL)"""


@query("r16_label_summary", check=f"""WITH {WIN_SQL}
SELECT count(*) AS total, count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE label = 0) AS negative, round((SELECT rate FROM w), 4) AS win_rate FROM v_labels""")
def r16(t: Tables) -> DataFrame:
    return evaluate.label_summary(t.v_labels)


@query("r20_win_rate", check=f"WITH {WIN_SQL} SELECT round(rate, 6) AS win_rate FROM w")
def r20(t: Tables) -> DataFrame:
    return evaluate.win_rate(t.v_labels.select("label", F.col("sampled_score").alias("score"))).withColumn("win_rate", F.round("win_rate", 6))


# One ranked list per source: its twenty newest items; relevant are its good-quality items.
RANKED_SQL = "SELECT task_id AS list_id, item_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, item_id DESC) AS INT) AS rank FROM v_items"
TRUTH_SQL = "SELECT i.task_id AS list_id, i.item_id, l.label FROM v_items i JOIN v_labels l ON l.item_id = i.item_id"
METRIC_SQL = f"""rk AS (SELECT * FROM ({RANKED_SQL}) WHERE rank <= 20), tr AS (SELECT list_id, item_id FROM ({TRUTH_SQL}) WHERE label = 1),
 rc AS (SELECT list_id, count(*) AS r FROM tr GROUP BY list_id), j AS (SELECT rk.*, tr.item_id IS NOT NULL AS hit FROM rk LEFT JOIN tr USING (list_id, item_id)),
 ks AS (SELECT unnest([5, 10, 20]) AS k), mt AS (SELECT j.list_id, k, any_value(coalesce(r, 0)) AS r, count(*) AS n, count(*) FILTER (WHERE hit AND rank <= k) AS h, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE hit AND rank <= k), 0) AS g
  FROM j CROSS JOIN ks LEFT JOIN rc USING (list_id) GROUP BY j.list_id, k),
 m AS (SELECT list_id, k, h / least(k, n) AS precision, CASE WHEN r = 0 THEN 0 ELSE h / r END AS recall, CASE WHEN r = 0 THEN 0 ELSE g / list_sum(list_transform(range(1, CAST(least(k, r) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg FROM mt)"""


def lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.sql(f"SELECT * FROM ({RANKED_SQL}) WHERE rank <= 20"), t.sql(TRUTH_SQL)


@query("r17_precision_at_k", check=f"WITH {METRIC_SQL} SELECT list_id, k, round(precision, 6) AS precision FROM m")
def r17(t: Tables) -> DataFrame:
    ranked, truth = lists(t)
    return evaluate.ranking_metrics(ranked, truth.filter("label = 1")).select("list_id", "k", F.round("precision", 6).alias("precision"))


@query("r18_recall_at_k", check=f"WITH {METRIC_SQL} SELECT list_id, k, round(recall, 6) AS recall FROM m")
def r18(t: Tables) -> DataFrame:
    ranked, truth = lists(t)
    return evaluate.ranking_metrics(ranked, truth.filter("label = 1")).select("list_id", "k", F.round("recall", 6).alias("recall"))


@query("r19_ndcg_at_k", check=f"WITH {METRIC_SQL} SELECT list_id, k, round(ndcg, 6) AS ndcg FROM m")
def r19(t: Tables) -> DataFrame:
    ranked, truth = lists(t)
    return evaluate.ranking_metrics(ranked, truth.filter("label = 1")).select("list_id", "k", F.round("ndcg", 6).alias("ndcg"))


@query("r21_evaluation_report", check=f"""WITH {METRIC_SQL}, ng AS (SELECT list_id, item_id FROM ({TRUTH_SQL}) WHERE label = 0)
SELECT list_id, 'precision' AS metric, k, round(precision, 6) AS value FROM m UNION ALL SELECT list_id, 'recall', k, round(recall, 6) FROM m UNION ALL SELECT list_id, 'ndcg', k, round(ndcg, 6) FROM m
UNION ALL SELECT rk.list_id, 'not_relevant_in_top', 10, CAST(count(ng.item_id) AS DOUBLE) FROM rk LEFT JOIN ng ON ng.list_id = rk.list_id AND ng.item_id = rk.item_id AND rk.rank <= 10 GROUP BY rk.list_id
UNION ALL SELECT ls.list_id, 'missed_relevant', 20, CAST(count(tr.item_id) AS DOUBLE) FROM (SELECT DISTINCT list_id FROM rk) ls LEFT JOIN (SELECT * FROM tr WHERE (list_id, item_id) NOT IN (SELECT (list_id, item_id) FROM rk)) tr ON tr.list_id = ls.list_id GROUP BY ls.list_id""")
def r21(t: Tables) -> DataFrame:
    ranked, truth = lists(t)
    made = evaluate.report(ranked, truth.filter("label = 1"), truth.filter("label = 0"))
    return made.withColumn("value", F.round("value", 6))


MODES_SQL = "md AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {', '.join(map(str, w))})" for m, w in recommend.MODES.items()) + ") v(mode, wt, wa, wr, we))"


@query("r22_compare_modes", check=f"""WITH RECURSIVE {FACTOR_SQL}, {MODES_SQL}, s AS (SELECT user_id, mode, item_id, round(least(1.0, wt * topic_score + 0.25 * affinity_score + wr * recency_score + we * engagement_score), 6) AS score FROM fx CROSS JOIN md)
SELECT user_id, mode, item_id, score, CAST(row_number() OVER (PARTITION BY user_id, mode ORDER BY score DESC, item_id DESC) AS INT) AS position FROM s""")
def r22(t: Tables) -> DataFrame:
    return recommend.compare_modes(factors(t), {"affinity_weight": 0.25})


CONFIGS_SQL = """SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 0.5e0 WHEN user_id % 4 = 1 THEN 0.2e0 END AS topic_match_weight, CASE WHEN user_id % 4 = 1 THEN 0.1e0 END AS affinity_weight,
 CASE WHEN user_id % 4 = 0 THEN 0.1e0 WHEN user_id % 4 = 1 THEN 0.5e0 END AS recency_weight, CASE WHEN user_id % 4 = 1 THEN 0.2e0 WHEN user_id % 4 = 3 THEN 0.15e0 END AS engagement_weight, count(*) AS n FROM v_interactions GROUP BY user_id"""


@query("r22_infer_mode", check=f"""WITH c AS ({CONFIGS_SQL}) SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'interest_first' WHEN 1 THEN 'fresh_first' WHEN 2 THEN 'balanced' END AS preference_mode FROM c""")
def r22_mode(t: Tables) -> DataFrame:
    return recommend.infer_mode(t.sql(CONFIGS_SQL)).select("user_id", "preference_mode")


TOPIC_LOG_SQL = """SELECT n.user_id, i.task_id AS topic, CASE WHEN n.interaction_id % 2 = 0 THEN 'custom' ELSE 'ai' END AS category, 0.5e0 + CAST(n.interaction_id % 16 AS DOUBLE) / 10 AS weight, n.interaction_id AS seq
 FROM v_interactions n JOIN v_items i ON i.item_id = n.item_id"""


@query("r23_user_topics", check=f"""WITH l AS ({TOPIC_LOG_SQL}), r AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY user_id, topic ORDER BY seq DESC) = 1)
SELECT user_id, topic, category, round(weight, 6) AS weight, seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, seq DESC) AS INT) AS position FROM r""")
def r23(t: Tables) -> DataFrame:
    return recommend.topics_by_weight(t.sql(TOPIC_LOG_SQL)).withColumn("weight", F.round("weight", 6))
