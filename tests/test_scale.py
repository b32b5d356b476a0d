"""Steps that must not grow faster than their input: what is shuffled and stored."""

from __future__ import annotations

import random
from datetime import datetime

from pyspark.sql import functions as F

from newsloom.operators import matching, recommend
from newsloom.plans import fixtures
from newsloom.streaming import item_feed
from newsloom.streaming.tables import AppendTable, KeyTable

NOW = datetime(2024, 1, 31)


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_titles_are_cut_before_items_meet_their_times(spark, tmp_path):
    spark.createDataFrame([(i, f"title {i}\nbody", "en", "src1", 5) for i in range(4)] + [(2, None, "en", None, 0), (None, "x", "en", "src2", 1)],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, NOW, 1, "view", 1.0, "") for i in [*range(3), 2, None, *range(3, 9)]],
                          "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    tables = fixtures.Tables(spark, str(tmp_path))
    assert sorted(map(str, tables.v_items.collect())) == sorted(map(str, tables.sql(fixtures.VIEWS["v_items"]).collect()))
    plan = plan_of(tables.v_items.select("item_id", "title"))
    assert "stringsplitsql" in plan.split("Join")[1] and "stringsplitsql" not in plan.split("Join")[0]


def test_titles_meet_without_their_tokens(spark):
    """Sets of 40 tokens have more bits than a sketch can hold apart, and none of their pairs may be lost."""
    rng = random.Random(3)
    sets = [set(rng.sample(range(60 + 400 * (i % 2)), 40)) for i in range(60)]
    df = spark.createDataFrame([(i, [f"w{t}" for t in s], [0]) for i, s in enumerate(sets)], "sid int, tokens array<string>, blocks array<int>")
    found = matching.similar_sets(df, df, 0.5, keep=F.col("l_sid") < F.col("r_sid"))
    want = {(i, j) for j in range(60) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5}
    assert want and {(r[0], r[1]) for r in found.collect()} == want
    meetings = [line for line in plan_of(found).splitlines() if "Join Inner" in line and "tok#" in line and "block#" in line]
    assert meetings and not any("array_intersect" in line for line in meetings)


def test_feed_decides_without_texts(spark, tmp_path, monkeypatch):
    cut, stored = item_feed.cut_lineage, []

    def seen(df):
        stored.append(df.columns)
        return cut(df)

    monkeypatch.setattr(item_feed, "cut_lineage", seen)
    schema = ("item_id bigint, task_id string, title string, summary string, url string, external_id string, is_read boolean, is_starred boolean, "
              "fetched_at timestamp_ntz, created_at timestamp_ntz")
    stored_as = schema + ", url_hash string, content_hash string"
    kept = AppendTable(spark, f"{tmp_path}/items", stored_as)
    for turn, ids in enumerate([(1, 2), (2, 3), (3, 4)]):
        spark.createDataFrame([(i + 10 * turn, "a", f"t{i}", f"long text {i}", f"https://x.org/{i}", None, False, False, NOW, NOW) for i in ids],
                              schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        item_feed.feed_items(stream, kept, KeyTable(spark, f"{tmp_path}/keys"), f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted((r["item_id"], r["summary"]) for r in kept.read().select("item_id", "summary").collect()) == [
        (1, "long text 1"), (2, "long text 2"), (13, "long text 3"), (24, "long text 4")]
    assert stored and all("summary" not in columns and "title" not in columns for columns in stored)


def factors_of(spark):
    """Readers 1, 2 and NULL; the last one has no factor of its own, and 3 only interactions."""
    items = spark.createDataFrame(
        [(i, f"s{i % 2}" if i else None, "Rust" if i % 2 else "other", None, False, NOW, NOW) for i in range(6)] + [(None, "s1", "Rust", None, False, NOW, NOW)],
        "item_id bigint, task_id string, title string, summary string, is_read boolean, fetched_at timestamp_ntz, created_at timestamp_ntz")
    tasks = spark.createDataFrame([("s0", "Zero"), ("s1", "One")], "task_id string, name string")
    topics = spark.createDataFrame([(1, "rust", 1.0), (None, "rust", 1.0)], "user_id bigint, topic string, weight double")
    affinity = spark.createDataFrame([(2, "task", "s1", 0.5), (2, "platform", "Zero", 0.2), (None, "task", "s1", 0.9)],
                                     "user_id bigint, affinity_type string, affinity_value string, affinity_score double")
    seen = spark.createDataFrame([(1, 2, "view", 30), (3, 2, "view", 30), (None, 2, "view", 30), (1, None, "view", 30)],
                                 "user_id bigint, item_id bigint, interaction_type string, dwell_seconds int")
    return recommend.score_factors(items, tasks, topics, affinity, seen, NOW)


def test_factors_lie_by_reader(spark):
    made = factors_of(spark)
    got = {(r["user_id"], r["item_id"]): (r["topic_score"], r["matched_topic"], r["affinity_score"], round(r["engagement_score"], 6)) for r in made.collect()}
    assert len(got) == made.count() == 21 and {u for u, _ in got} == {1, 2, None}
    assert got[1, 1] == (1.0, "rust", 0.0, 0.0) and got[1, 2] == (0.0, None, 0.0, round((1 / 3 + 1) / 2, 6)) and got[1, None] == (0.0, None, 0.0, 0.0)
    assert got[2, 1] == (0.0, None, 0.3, 0.0) and got[2, 4] == (0.0, None, 0.4 * 0.2, 0.0) and got[2, 0] == (0.0, None, 0.0, 0.0)
    assert all(v == (0.0, None, 0.0, 0.0) for (u, _), v in got.items() if u is None)
    labels = spark.createDataFrame([(1,), (99,), (None,)], "item_id bigint")
    sampled = recommend.sample_for_labeling(recommend.score_candidates(made), labels)
    assert {r["item_id"] for r in sampled.collect()} == {None, 0, 2, 3, 4, 5}
    # Rows of readers times pool are ranked where they lie.
    for ranked in (recommend.recommend(made), recommend.compare_modes(made), sampled):
        ranked.collect()
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan
        assert not [line for line in plan.splitlines() if "hashpartitioning(user_id" in line and "ENSURE_REQUIREMENTS" in line]


def test_readers_of_a_topic_are_dealt_out(spark):
    items = spark.createDataFrame([(i, "the news", None) for i in range(5)], "item_id bigint, title string, summary string")
    topics = spark.range(4000).selectExpr("id AS user_id", "'the news' AS topic", "1.0D AS weight")
    made = recommend.topic_scores(items, topics)
    assert made.count() == 20_000 and made.filter("topic_score = 1 AND matched_topic = 'the news'").count() == 20_000
    assert "_part#" in "".join(line for line in plan_of(made).splitlines() if "Join Inner" in line and "topic#" in line)
