"""Hotness, profile, relations, edits, similarity join and clustering on small tables."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.functions import windows
from newsloom.operators import clustering, matching
from newsloom.operators.threads import edit, hotness, relations, rollup

NOW = datetime(2026, 10, 7, 12)
MEMBER = "thread_id string, item_id int, task_id string, title string, fetched_at timestamp_ntz, similarity double, match_reason string"


def members(spark, *rows):
    return spark.createDataFrame(list(rows), MEMBER)


def at(hours):
    return NOW - timedelta(hours=hours)


def test_hotness_half_life_window_and_sources(spark):
    df = members(
        spark, ("now", 1, "a", "t", at(0), 1.0, ""), ("day", 2, "a", "t", at(24), 1.0, ""), ("edge", 3, "a", "t", at(48), 1.0, ""),
        ("old", 4, "a", "t", at(48.01), 1.0, ""), ("future", 5, "a", "t", at(-5), 1.0, ""), ("same", 6, "a", "t", at(0), 1.0, ""),
        ("same", 7, "a", "t", at(1), 1.0, ""), ("two", 8, "a", "t", at(0), 1.0, ""), ("two", 9, "b", "t", at(24), 1.0, ""), ("bad", 10, "a", "t", None, 1.0, ""))
    got = {r["thread_id"]: r["hotness"] for r in hotness.hotness(df, str(NOW)).collect()}
    assert got == {"now": 1.0, "day": 0.5, "edge": 0.25, "old": 0.0, "future": 1.0, "same": 1.0, "two": 1.5, "bad": 0.0}


def test_momentum(spark):
    df = members(spark, ("new", 1, "a", "t", at(1), 1.0, ""), ("fade", 2, "a", "t", at(24), 1.0, ""), ("fade", 3, "b", "t", at(30), 1.0, ""))
    got = {r["thread_id"]: r for r in hotness.momentum(df, str(NOW)).collect()}
    assert got["new"]["previous"] == 0.0 and got["new"]["delta"] == got["new"]["hotness"]
    assert got["fade"]["delta"] < 0 and got["fade"]["previous"] == pytest.approx(1 + 2 ** (-6 / 24), abs=1e-4)


def test_profile(spark):
    names = spark.createDataFrame([("a", "A"), ("b", "B")], "task_id string, name string")
    df = members(
        spark, ("t", 1, "a", "x", at(30), 1.0, "initial_item"), ("t", 2, "a", "xx", at(20), 0.6, ""), ("t", 3, "b", "y", at(2), 0.8, ""), ("t", 4, "zz", "y", at(1), None, ""),
        ("u", 5, "a", "x", at(3), 1.0, "no_match"))
    got = {r["thread_id"]: r for r in rollup.profile(df, names, str(NOW)).collect()}
    t, u = got["t"], got["u"]
    assert (t["item_count"], t["platform_count"], t["recent_6h_count"], t["recent_24h_count"], t["matched_item_count"]) == (4, 3, 2, 3, 2)
    assert (t["similarity_avg"], t["similarity_max"], t["confidence"], t["is_cross_platform"], t["span_hours"]) == (0.7, 0.8, "high", True, 29.0)
    assert [(p["platform"], p["count"]) for p in t["platform_breakdown"]] == [("A", 2), ("B", 1), ("unknown", 1)]
    assert u["similarity_avg"] is None and u["confidence"] is None and u["matched_item_count"] == 0


def test_roll_up_title_and_repeats(spark):
    df = members(spark, ("t", 1, "a", "long", at(3), 1.0, ""), ("t", 2, "b", "also", at(2), 1.0, ""), ("t", 2, "b", "also", at(2), 1.0, ""))
    r = rollup.roll_up(df).first()
    assert (r["item_count"], r["title"], r["platforms"]) == (2, "long", ["a", "b"])


def test_merge_chain_and_relations(spark):
    df = spark.createDataFrame([("a", 1, 0.4), ("b", 2, 0.5), ("c", 3, 0.6), ("c", 1, 0.7)], "thread_id string, item_id int, similarity double")
    rel = spark.createDataFrame([("a", "b", 0.3, "auto"), ("b", "d", 0.2, "auto"), ("c", "d", 0.1, "split")], "thread_a string, thread_b string, similarity double, source string")
    moves = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c")], "thread_id string, target_id string")
    m, r = edit.merge_threads(df, rel, moves)
    assert {tuple(x) for x in m.collect()} == {("c", 1, 0.7), ("c", 2, 1.0), ("c", 3, 0.6)}
    assert [tuple(x) for x in r.collect()] == [("c", "d", 0.2, "split")]
    with pytest.raises(ValueError, match="cycle"):
        edit.resolve_merges(spark.createDataFrame([("a", "b"), ("b", "a")], "thread_id string, target_id string"), max_rounds=3)


def test_split_refuses_everything(spark):
    df = members(spark, ("t", 1, "a", "one", at(1), 0.4, ""), ("t", 2, "a", "two", at(1), 0.8, ""), ("u", 3, "a", "x", at(1), 0.9, ""))
    rel = spark.createDataFrame([], "thread_a string, thread_b string, similarity double, source string")
    moves = spark.createDataFrame([("t", 1, "t2", None), ("u", 3, "u2", None)], "thread_id string, item_id int, new_thread_id string, new_title string")
    m, r, titles = edit.split_threads(df, rel, moves)
    assert {(x["thread_id"], x["item_id"], x["similarity"]) for x in m.collect()} == {("t2", 1, 1.0), ("t", 2, 0.8), ("u", 3, 0.9)}
    assert [tuple(x) for x in r.collect()] == [("t", "t2", 0.4, "split")]
    assert [tuple(x) for x in titles.collect()] == [("t2", "one")]


def test_rejected_pairs(spark):
    log = spark.createDataFrame([("b", "a", 0.3, "auto", 1), ("a", "b", 0.9, "auto", 2), ("c", "d", 0.3, "auto", 3), ("d", "c", 0.4, "split", 4), ("e", "e", 1.0, "auto", 5)],
                                "thread_a string, thread_b string, similarity double, source string, seq int")
    rejects = spark.createDataFrame([("d", "c", "reject_merge")], "thread_id string, target_thread_id string, override_type string")
    assert {tuple(r) for r in relations.record_relations(log, rejects).collect()} == {("a", "b", 0.3, "auto"), ("c", "d", 0.4, "split")}


def jac(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold", [0.2, 0.35, 0.6])
def test_similar_sets_equals_brute_force(spark, threshold):
    """A third of the sets hold one hot token, and sizes vary."""
    rng = random.Random(5)
    seen, sets = set(), []
    while len(sets) < 150:
        s = {f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(1, 9))} | ({"hot"} if rng.random() < 0.34 else set())
        if frozenset(s) not in seen:
            seen.add(frozenset(s))
            sets.append(s)
    df = spark.createDataFrame([(i, sorted(s), [0]) for i, s in enumerate(sets)], "sid int, tokens array<string>, blocks array<int>")
    got = {(r["l_sid"], r["r_sid"]) for r in matching.similar_sets(df, df, threshold, keep=F.col("l_sid") < F.col("r_sid")).collect()}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jac(sets[i], sets[j]) >= threshold}
    rows = matching.similar_sets(df, df, threshold, keep=F.col("l_sid") < F.col("r_sid")).count()
    assert got == want and rows == len(want)


def test_similar_titles(spark):
    new = spark.createDataFrame([(1, "alpha beta gamma"), (2, "single"), (3, "nothing shared here")], "item_id int, title string")
    old = spark.createDataFrame([(10, "alpha beta delta"), (11, "beta alpha gamma"), (12, "gamma, beta; alpha"), (13, "single")], "item_id int, title string")
    assert [tuple(r) for r in matching.similar_titles(new, old).collect()] == [(1, 11, 1.0)]


@pytest.mark.parametrize("part_edges", [500_000, 40])
def test_members_equal_sequential_choice(spark, monkeypatch, part_edges):
    """In one part, and in parts that wait for each other."""
    monkeypatch.setattr(clustering, "PART_EDGES", part_edges)
    rng = random.Random(3)
    edges = {(b, a) for _ in range(260) for a, b in [sorted(rng.sample(range(90), 2))]}
    seeds: set[int] = set()
    for node in range(90):
        if not any((node, s) in edges for s in seeds):
            seeds.add(node)
    df = spark.createDataFrame(sorted(edges), "later int, earlier int")
    got = {r[0] for r in clustering.choose_members(df).collect()}
    assert got == set(range(90)) - seeds


def clusters(rows):
    return {r["item_id"]: r["thread_id"] for r in rows.collect()}


ITEM = "item_id int, task_id string, title string, summary string, fetched_at timestamp_ntz"


def test_clustering_basics(spark):
    df = spark.createDataFrame([
        (1, "a", "Acme launches orbital rocket today", "", at(10)), (2, "b", "Acme orbital rocket launches today again", "", at(9)),
        (3, "a", "Completely different gardening story", "", at(8)), (4, "b", "Acme launches orbital rocket today", "", at(-30)),
        (5, "c", "acme ORBITAL rocket: today launches", "", at(7)), (6, "c", "the", "", at(7))], ITEM)
    rows, _ = clustering.cluster(df)
    got = clusters(rows)
    assert got[1] == got[2] == got[5] == 1
    assert got[3] == 3 and got[4] == 4 and got[6] == 6
    again, _ = clustering.cluster(df.repartition(7, "title"))
    assert clusters(again) == got


@pytest.mark.parametrize("probe", [256, 2])
def test_clustering_equals_a_replay(spark, probe):
    """All items scored against all earlier ones, in order; with small probes in several turns."""
    rng = random.Random(17)
    words = ["acme", "orbit", "rocket", "garden", "market", "苹果公司今天发布新款手机", "苹果公司今日发布新款手机", "openai/gym", "v2.1", "the"]
    rows = [(i, rng.choice(["a", "b", "c", "", None]), " ".join(rng.choices(words, k=rng.randint(0, 4))), rng.choice([None, "", "acme 2024-01-05"]),
             None if i % 17 == 0 else at(rng.choice([1, 2, 5, 20, 30, 31, 60]) + rng.choice([0, 0.5]))) for i in range(90)]
    df = spark.createDataFrame(rows, ITEM)
    got, relations = clustering.cluster(df, probe=probe)
    y = df.select(F.col("item_id").alias("l"), matching.item_struct().alias("y"))
    x = df.select(F.col("item_id").alias("r"), matching.thread_struct(F.col("fetched_at"), F.array("task_id")).alias("x"))
    total = {(r["l"], r["r"]): r["t"] for r in y.crossJoin(x).select("l", "r", matching.thread_score(F.col("y"), F.col("x"))["total"].alias("t")).collect()}
    times = {r[0]: r[4] for r in rows}
    seeds, home, near = [], {i: i for i, t in times.items() if t is None}, {}
    for i in sorted((i for i, t in times.items() if t is not None), key=lambda i: (times[i], i)):
        known = [s for s in seeds if times[i] - times[s] <= timedelta(hours=24)]
        best = min(known, key=lambda s: (-total[i, s], times[s], s), default=None)
        if best is not None and total[i, best] >= 0.35:
            home[i] = best
            continue
        home[i] = i
        seeds.append(i)
    for i in seeds:
        known = [s for s in seeds if (times[s], s) < (times[i], i) and times[i] - times[s] <= timedelta(hours=24)]
        best = min(known, key=lambda s: (-total[i, s], times[s], s), default=None)
        if best is not None and total[i, best] >= 0.35 * 0.67:
            near[i] = best
    assert clusters(got) == home
    assert {r["thread_id"]: r["related_id"] for r in relations.collect()} == near


def test_titles_without_blanks_and_missing_times(spark):
    df = spark.createDataFrame([(1, "a", "苹果公司今天发布新款手机", "", at(2)), (2, "b", "苹果公司今日发布新款手机", "", at(1)),
                                (3, "a", "苹果公司今天发布新款手机", "", None)], ITEM)
    assert clusters(clustering.cluster(df)[0]) == {1: 1, 2: 1, 3: 3}
    assert clustering.cluster(df.limit(0))[0].count() == 0


def test_fast_score_equals_the_expression(spark):
    rng = random.Random(8)
    words = ["acme", "orbit", "rocket", "openai", "v2.1", "2024-01-05", "the", "a/b", "12"]
    df = spark.createDataFrame([(i, rng.choice(["a", "b", "", None]), " ".join(rng.choices(words, k=rng.randint(0, 5))), rng.choice([None, "python r 33"]),
                                 None if i == 0 else at(rng.randint(0, 90))) for i in range(25)], ITEM)
    y = df.select(F.col("item_id").alias("l"), matching.item_struct().alias("y"))
    x = df.select(F.col("item_id").alias("r"), matching.thread_struct(F.col("fetched_at"), F.array("task_id")).alias("x"))
    pairs = y.crossJoin(x)
    want = {(r[0], r[1]): r[2] for r in pairs.select("l", "r", matching.thread_score(F.col("y"), F.col("x"))).collect()}
    assert {(r[0], r[1]): r[2] for r in matching.score_pairs(pairs, ["l", "r"]).collect()} == want
    some = {(r[0], r[1]) for r in matching.score_pairs(pairs, ["l", "r"], 0.3).collect()}
    assert some == {k for k, v in want.items() if v["total"] >= 0.3}


def test_copied_title_makes_one_thread_per_window(spark):
    """Hundreds of copies of one title hold one place a slot among the items that are compared."""
    rows = [(i, f"s{i % 9}", "Daily market digest numbers" if i % 3 == 0 else f"story number{i} about topic{i}", "", at(20) + timedelta(seconds=i)) for i in range(900)]
    got = clusters(clustering.cluster(spark.createDataFrame(rows, ITEM))[0])
    assert len(got) == 900
    assert len({got[i] for i in range(0, 900, 3)}) <= 2


def test_catalog_gate(spark):
    tasks = spark.createDataFrame([("a", "A", "active", "discussion", None), ("b", "B", "active", "catalog", None), ("c", "C", "paused", "catalog", None)],
                                  "task_id string, name string, status string, content_kind string, deleted_at timestamp_ntz")
    df = spark.createDataFrame([(1, "a", "t", "", NOW), (2, "b", "t", "", NOW), (3, "c", "t", "", NOW), (4, "gone", "t", "", NOW)], ITEM)
    got = {r["item_id"]: r["platform"] for r in clustering.clusterable(df, tasks).collect()}
    assert got == {1: "A", 3: "unknown", 4: "unknown"}


THREAD = "thread_id string, title string, platforms array<string>, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"


def test_prefilter_and_decision(spark):
    items = spark.createDataFrame([(1, "a", "rocket launch delayed again", "", NOW)], ITEM)
    rows = [(f"t{i}", f"unrelated subject {i}", ["a"], at(1), at(1 + i / 100)) for i in range(30)] + [("hit", "rocket launch delayed", ["b"], at(2), at(20))]
    threads = spark.createDataFrame(rows, THREAD)
    assert matching.candidate_threads(threads, str(NOW), hours=10).count() == 30
    assert matching.candidate_threads(threads, str(NOW), limit=7).count() == 7
    known = matching.candidate_threads(threads, str(NOW))
    short = matching.prefilter(items, known).collect()
    assert [(r["thread_id"], r["overlap"], r["position"]) for r in short] == [("hit", 0.75, 0)]
    assert matching.prefilter(items, known, keep=0).count() == 0
    d = matching.decide(items, known, 0.35).first()
    assert (d["action"], d["thread_id"]) == ("join", "hit") and d["match_reason"].startswith("score=0.")
    none = matching.decide(items, threads.filter("1 = 0"), 0.35).first()
    assert none["action"] == "create" and none["related_thread_id"] is None and none["score"] is None
    with pytest.raises(ValueError, match="time and source alone"):
        matching.decide(items, known, 0.3)


@pytest.mark.parametrize("threshold", [0.35, 0.5])
def test_decision_is_over_all_threads(spark, threshold):
    """Best of all pairs, most of them without a common word, against every pair scored by the expression."""
    rng = random.Random(23)
    words = ["acme", "orbit", "rocket", "garden", "苹果公司今天", "苹果公司今日", "ww", "qq", "zz", "kk"]
    items = spark.createDataFrame([
        (i, rng.choice(["a", "b", "c", "", None]), " ".join(rng.choices(words, k=rng.randint(0, 2))), "",
         None if i % 13 == 0 else at(rng.choice([0, 3, 6, 6.5, 12, 30]))) for i in range(60)], ITEM)
    threads = spark.createDataFrame([
        (f"t{i:03}", " ".join(rng.choices(words, k=rng.randint(0, 2))), rng.sample(["a", "b", "c"], rng.randint(0, 3)), at(23.5),
         at(rng.choice([0, 0.1, 3, 6, 9, 12, 12.25]))) for i in range(80)], THREAD)
    y = items.select("item_id", matching.item_struct().alias("y"))
    x = threads.select("thread_id", "last_seen_at", matching.thread_struct(F.col("last_seen_at"), F.col("platforms")).alias("x"))
    best = {}
    for r in y.crossJoin(x).select("item_id", "thread_id", "last_seen_at", matching.thread_score(F.col("y"), F.col("x"))["total"].alias("t")).collect():
        row = (-r["t"], -r["last_seen_at"].timestamp(), r["thread_id"])
        best[r["item_id"]] = min(best.get(r["item_id"], row), row)
    got = {r["item_id"]: r for r in matching.decide(items, threads, threshold).collect()}
    assert got.keys() == best.keys()
    for i, (total, _, thread) in best.items():
        want = ("join", thread, None) if -total >= threshold else ("create", None, thread if -total >= threshold * 0.67 else None)
        assert (got[i]["action"], got[i]["thread_id"], got[i]["related_thread_id"]) == want, i


@pytest.mark.parametrize("group_rows", [2_000_000, 20])
def test_running_equals_plain_window(spark, monkeypatch, group_rows):
    """Time buckets, and range partitions where a bucket is overfull."""
    monkeypatch.setattr(windows, "GROUP_ROWS", group_rows)
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 3)}", NOW + timedelta(minutes=rng.choice([0, 0, 1]) * rng.randint(0, 5000)), i, rng.randint(0, 9)) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int, v int")
    got = windows.running(df, ["k"], ["ts", "id"], windows.hour("ts"), {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))})
    df.createOrReplaceTempView("running_rows")
    want = spark.sql("""SELECT id, sum(v) OVER w AS s, max(v) OVER w AS m, lag(v) OVER (PARTITION BY k ORDER BY ts, id) AS p
      FROM running_rows WINDOW w AS (PARTITION BY k ORDER BY ts, id ROWS UNBOUNDED PRECEDING)""")
    assert {tuple(r) for r in got.select("id", "s", "m").collect()} == {(r["id"], r["s"], r["m"]) for r in want.collect()}
    prev = windows.previous_value(df, ["k"], ["ts", "id"], windows.hour("ts"), "v", "p")
    assert {tuple(r) for r in prev.select("id", "p").collect()} == {(r["id"], r["p"]) for r in want.collect()}


def test_embedding_semantics(spark):
    cols = "item_id int, task_id string, title string, summary string, fetched_at timestamp_ntz, vec array<float>"
    df = spark.createDataFrame([(1, "a", "red fox jumps high", "", at(3), [1.0, 0.0]), (2, "b", "red fox sleeps", "", at(2), [0.0, 1.0])], cols)
    threads = df.filter("item_id = 1").select(
        F.lit("t").alias("thread_id"), "title", F.array("task_id").alias("platforms"), F.col("fetched_at").alias("first_seen_at"),
        F.col("fetched_at").alias("last_seen_at"), "vec")
    scored = matching.scored_threads(df, threads, semantic="embedding", embedding="vec")
    got = {r["item_id"]: r["score"] for r in scored.collect()}
    assert got[1]["semantic"] == 1.0 and got[2]["semantic"] == 0.0
    rows, _ = clustering.cluster(df, semantic="embedding", embedding="vec", threshold=0.9)
    assert len(clusters(rows)) == 2


def test_clustering_stream_keeps_late_items_aside(spark, tmp_path):
    from newsloom.streaming import threads as stream
    schema = "item_id bigint, task_id string, title string, summary string, fetched_at timestamp_ntz"
    tasks = spark.createDataFrame([("a", "A", "active", "discussion", None), ("z", "Z", "active", "catalog", None)],
                                  "task_id string, name string, status string, content_kind string, deleted_at timestamp_ntz")
    arrivals = [
        [(1, "a", "Acme launches orbital rocket", "", at(10)), (2, "z", "Acme launches orbital rocket", "", at(9)), (3, "a", "Gardening", "", None)],
        [(4, "b", "Acme launches orbital rocket today", "", at(8)), (5, "b", "Acme launches orbital rocket", "", at(13)),
         (6, "b", "Acme launches orbital rocket", "", at(10.5))]]
    store = stream.ThreadStore(spark, f"{tmp_path}/threads")
    for rows in arrivals:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        stream.cluster_stream(source, tasks, store, f"{tmp_path}/checkpoint").awaitTermination()
    assert {r["item_id"]: r["thread_id"] for r in store.members.read().collect()} == {1: 1, 3: 3, 4: 1, 6: 6}
    assert [r["item_id"] for r in store.late.read().collect()] == [5]
    rows = {r["thread_id"]: r for r in store.current().collect()}
    assert rows[1]["title"] == "Acme launches orbital rocket today" and rows[1]["item_count"] == 2
    assert rows[1]["platforms"] == ["A", "unknown"] and rows[1]["last_seen_at"] == at(8)
