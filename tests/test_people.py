"""Recommendation, evaluation, monitoring, ledger and streaming rules on small tables."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.functions import windows
from newsloom.operators import evaluate, ledger, monitor, recommend, search
from newsloom.streaming import affinity, monitor as live
from newsloom.streaming.tables import AppendTable, StateTable

NOW = datetime(2026, 10, 7, 12)


def ranked(spark, ids):
    return spark.createDataFrame([("l", x, i) for i, x in enumerate(ids, 1)], "list_id string, item_id string, rank int")


def relevant(spark, ids):
    return spark.createDataFrame([("l", x) for x in ids], "list_id string, item_id string")


def test_ranking_metrics(spark):
    rows = evaluate.ranking_metrics(ranked(spark, "abcde"), relevant(spark, "acx"), (1, 3, 20)).collect()
    got = {r["k"]: r for r in rows}
    assert got[3]["precision"] == pytest.approx(2 / 3) and got[20]["precision"] == pytest.approx(2 / 5)
    assert got[3]["recall"] == pytest.approx(2 / 3)
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert got[3]["ndcg"] == pytest.approx((1 + 1 / math.log2(4)) / ideal)
    none = evaluate.ranking_metrics(ranked(spark, "ab"), relevant(spark, ""), (5,)).first()
    assert (none["recall"], none["ndcg"]) == (0.0, 0.0)
    with pytest.raises(ValueError):
        evaluate.ranking_metrics(ranked(spark, "a"), relevant(spark, "a"), (0,))


def test_win_rate(spark):
    def rate(pos, neg):
        df = spark.createDataFrame([(1, float(p)) for p in pos] + [(0, float(n)) for n in neg], "label int, score double")
        return evaluate.win_rate(df).first()["win_rate"]
    assert rate([0.9, 0.8], [0.1]) == 1.0
    assert rate([0.5], [0.5]) == 0.5
    assert rate([0.2, 0.9], [0.5, 0.2]) == pytest.approx((0.5 + 2) / 4)
    assert rate([0.9], []) is None


def deltas(spark, rows):
    return spark.createDataFrame([(i, 1, NOW + timedelta(minutes=m), "task", "x", d) for i, (m, d) in enumerate(rows)], affinity.DELTA_SCHEMA)


def plain_fold(values):
    s = None
    for d in values:
        s = d if s is None else min(1.0, max(0.0, 0.9 * s + 0.1 * d))
    return s


@pytest.mark.parametrize("group_rows", [2_000_000, 3])
def test_affinity_fold_and_stream_parts(spark, monkeypatch, group_rows):
    monkeypatch.setattr(windows, "GROUP_ROWS", group_rows)
    rows = [(i * 17, 0.01 * (i % 11)) for i in range(40)]
    whole = recommend.fold_affinity(deltas(spark, rows), ["user_id"]).first()
    assert whole["affinity_score"] == pytest.approx(plain_fold([d for _, d in rows])) and whole["interaction_count"] == 40
    ordered = deltas(spark, rows)
    parts = [ordered.filter(f"interaction_id % 3 = {i}") for i in (2, 0, 1)]
    log, hours = ordered.limit(0), spark.createDataFrame([], affinity.HOUR_SCHEMA)
    for part in parts:
        hours = hours.unionByName(affinity.touched_hours(part, log))
        log = log.unionByName(part)
    r = affinity.current_affinity(hours).first()
    assert r["affinity_score"] == pytest.approx(whole["affinity_score"]) and r["interaction_count"] == 40


def test_late_update_folds_its_own_hour_only(spark):
    log = deltas(spark, [(0, 0.5), (10, 1.0), (70, 0.2), (140, 0.9)])
    late = spark.createDataFrame([(9, 1, NOW + timedelta(minutes=5), "task", "x", 0.3)], affinity.DELTA_SCHEMA)
    made = affinity.touched_hours(late, log).collect()
    assert [r["n"] for r in made] == [3]
    hours = affinity.touched_hours(log, log.limit(0)).unionByName(affinity.touched_hours(late, log))
    r = affinity.current_affinity(hours).first()
    assert r["affinity_score"] == pytest.approx(plain_fold([0.5, 0.3, 1.0, 0.2, 0.9])) and r["interaction_count"] == 5
    assert affinity.touched_hours(late.limit(0), log).count() == 0


RUN = "execution_id int, task_id string, status string, executed_at timestamp_ntz"


def runs(spark, text, start=0):
    names = {"f": "failure", "e": "warning", "s": "success"}
    return spark.createDataFrame([(start + i, "t", names[c], NOW + timedelta(hours=start + i)) for i, c in enumerate(text)], RUN)


def plain_streak(text):
    fails = empties = 0
    error = False
    for c in text:
        if c == "f":
            fails += 1
            error |= fails >= 3
        elif c == "e":
            empties, fails = empties + 1, 0
        else:
            fails = empties = 0
    return fails, empties, error


@pytest.mark.parametrize("group_rows", [2_000_000, 1])
@pytest.mark.parametrize("text", ["ffef", "fffs", "seffe", "fefefff"])
def test_streaks_batch_and_stream(spark, monkeypatch, text, group_rows):
    monkeypatch.setattr(windows, "GROUP_ROWS", group_rows)
    tasks = spark.createDataFrame([("t", "active")], "task_id string, status string")
    want = plain_streak(text)
    r = monitor.streaks(runs(spark, text), tasks).first()
    assert (r["consecutive_failures"], r["consecutive_empty"], r["status"] == "error") == want
    state = spark.createDataFrame([], live.STREAK_SCHEMA)
    for start, end in ((0, 2), (2, len(text))):
        state = live.fold_streaks(runs(spark, text[start:end], start), state)
    s = state.first()
    assert (s["consecutive_failures"], s["consecutive_empty"], s["reached_error"]) == want


def test_health_without_runs(spark):
    tasks = spark.createDataFrame([("t",)], "task_id string")
    empty = spark.createDataFrame([], "execution_id int, task_id string, status string, items_fetched int, items_new int, executed_at timestamp_ntz")
    r = monitor.source_health(tasks, empty, str(NOW)).first()
    assert (r["health_score"], r["status"], r["total_executions"]) == (0.0, "unknown", 0)


def test_transitions(spark):
    rows = [(i, "r", s, NOW + timedelta(days=i)) for i, s in enumerate(["queued", "running", "completed", "running"])]
    df = spark.createDataFrame(rows, "event_id int, execution_id string, state string, created_at timestamp_ntz")
    got = [r["allowed"] for r in monitor.check_transitions(df).orderBy("event_id").collect()]
    assert got == [True, True, False, False]


def test_validation_default_field_quirk(spark):
    crawls = spark.createDataFrame([("a", 200), ("b", 404), ("c", 204)], "crawl_id string, http_status int")
    items = spark.createDataFrame([("a", "t", "https://e.com")], "crawl_id string, title string, url string")
    got = {r["crawl_id"]: r for r in monitor.validate_batches(crawls, items).collect()}
    assert got["a"]["status"] == "semantic_failed" and got["a"]["warnings"] == ["Field coverage (50.0%) < minimum (90.0%)"]
    assert got["b"]["error"] == "HTTP 404" and got["c"]["status"] == "parse_failed"
    assert {r["crawl_id"]: r["status"] for r in monitor.validate_batches(crawls, items, ("title", "url")).collect()}["a"] == "valid"


def test_topics_and_reasons(spark):
    topics = spark.createDataFrame([(1, "Rust", 2.0), (1, "machine learning", 1.0), (2, "o", 1.0), (2, " ", 3.0), (3, "no", 1.0)],
                                   "user_id int, topic string, weight double")
    items = spark.createDataFrame([(1, "Rust rules", None), (2, "learning things", ""), (3, "nope", "a trustful one"), (4, "the", "")],
                                  "item_id int, title string, summary string")
    got = {(r["user_id"], r["item_id"]): (round(r["topic_score"], 6), r["matched_topic"]) for r in recommend.topic_scores(items, topics).collect()}
    assert got == {(1, 1): (round(2 / 3, 6), "Rust"), (1, 2): (round(0.5 / 3, 6), None), (1, 3): (round(2 / 3, 6), "Rust"),
                   (2, 3): (0.25, "o"), (3, 3): (1.0, "no")}
    rows = spark.createDataFrame([("Rust", "Src", 0.5, 0.06, 1.0, 0.6)], "matched_topic string, task_name string, topic_score double, affinity_score double, recency_score double, engagement_score double")
    kinds = [r["type"] for r in recommend.with_reasons(rows).first()["reasons"]]
    assert kinds == ["topic", "affinity", "recency", "engagement"]


def test_modes(spark):
    df = spark.createDataFrame([(None, None, None, None), (0.5, 0.3, 0.1, 0.1), (0.3, 0.3, 0.3, 0.1)], ", ".join(f"{w} double" for w in recommend.WEIGHTS))
    assert [r["preference_mode"] for r in recommend.infer_mode(df).collect()] == ["balanced", "interest_first", None]


def test_search(spark):
    df = spark.createDataFrame([(1, "Café au lait", "x"), (2, "au cafe", "lait"), (3, "x", "le CAFE   au lait!"), (4, "100%_sure", None)],
                               "item_id int, title string, summary string")
    assert {r[0] for r in search.phrase_search(df, "cafe AU").select("item_id").collect()} == {1, 3}
    index = search.token_index(df)
    assert {r[0] for r in search.phrase_search_indexed(index, "Café au lait").collect()} == {1, 3}
    assert search.phrase_search_indexed(index, "!!").count() == 0
    assert {r[0] for r in search.substring_search(df, "%_S").select("item_id").collect()} == {4}


def test_token_index_prunes_folders(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i} again again", "") for i in range(50)], "item_id int, title string, summary string")
    path = str(tmp_path / "index")
    search.write_token_index(search.token_index(df), path)
    assert search.phrase_search_indexed(spark.read.parquet(path), "again again").count() == 50


def test_ledger_reuse(spark):
    receipts = spark.createDataFrame([(1, "m", "h", "done", "old", NOW), (2, "m", "h", "done", "new", NOW + timedelta(1)), (3, "m", "g", "failed", None, NOW)],
                                     "receipt_id int, model string, prompt_hash string, status string, result_text string, created_at timestamp_ntz")
    prompts = spark.createDataFrame([("m", "h"), ("m", "g")], "model string, prompt_hash string")
    got = {r["prompt_hash"]: (r["reused_text"], r["to_call"]) for r in ledger.split_reusable(prompts, receipts).collect()}
    assert got == {"h": ("new", False), "g": (None, True)}


def test_tables_replay(spark, tmp_path):
    table = AppendTable(spark, str(tmp_path / "a"), "x int")
    assert table.before(0).count() == 0
    for _ in range(2):
        table.write(spark.createDataFrame([(1,)], "x int"), 0)
    table.write(spark.createDataFrame([(2,)], "x int"), 1)
    assert table.read().count() == 2 and [r[0] for r in table.before(1).collect()] == [1]
    state = StateTable(spark, str(tmp_path / "s"), "x int")
    assert state.version(-1).count() == 0


@pytest.mark.parametrize("needle", ["", "ab", "ABC", "50%_", "aaaa", "\u0130x\u0131", "c\U0001F600d", "nowhere"])
def test_substring_index_equals_scan(spark, tmp_path, needle):
    texts = [(1, "xABCabc", None), (2, None, "50%_ off"), (3, "ab", ""), (4, "aaa", "aaa"), (5, "baaaab", "q"),
             (6, "\u0130x\u0131", "\u0130X\u0131"), (7, "abC\U0001F600D", "x")]
    items = spark.createDataFrame(texts, "item_id int, title string, summary string")
    path = f"{tmp_path}/grams"
    search.write_token_index(search.gram_index(items), path)
    index = spark.read.parquet(path)
    found = search.substring_search_indexed(index, items, needle)
    assert sorted(found.collect()) == sorted(search.substring_search(items, needle).collect())
    if len(needle) >= 3:
        plan = found._jdf.queryExecution().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
