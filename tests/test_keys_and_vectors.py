"""Key tables of streams, deduplication by narrow keys, nearest vectors."""

from __future__ import annotations

import math

import pytest

from newsloom.operators.dedup import drop_known
from newsloom.operators.vectors import nearest, unit_vectors
from newsloom.plans.fixtures import Tables
from newsloom.streaming.tables import KeyTable

KEYS = "kind string, key string"


def test_key_table_bases_replay_and_pruning(spark, tmp_path):
    table = KeyTable(spark, f"{tmp_path}/keys", buckets=8, every=2)
    seen = set()
    for epoch in range(6):
        for _ in range(2):  # each batch is replayed once
            assert {tuple(r) for r in table.before(epoch).collect()} == seen
            new = [("url", f"u{epoch}-{i}") for i in range(3)] if epoch != 3 else []
            table.write(spark.createDataFrame(new, KEYS), epoch)
        seen |= set(new)
    wanted = spark.createDataFrame([("url", "u0-1")], KEYS)
    found = table.before(6, wanted)
    assert ("url", "u0-1") in {tuple(r) for r in found.collect()}
    plan = found._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert table.before(6, wanted.limit(0)).count() == 0


def test_drop_known_keys(spark):
    schema = "item_id int, task_id string, external_id string, url_hash string, content_hash string, extra string"
    history = spark.createDataFrame([(1, "a", "1", "u1", "c1", ""), (2, None, "2", "u2", "", ""), (3, "1:", "x", None, None, "")], schema)
    batch = [(10, "a", "1", "n", "n", ""), (11, "b", "1", "n", "n", ""), (12, None, "1", "n", "n", ""), (13, "", "2", "n", "n", ""),
             (14, "a", None, "u1", "n", ""), (15, "a", "", "", "c1", ""), (16, None, None, None, None, ""), (17, "1", ":x", "n", "", "")]
    rows = spark.createDataFrame(batch, schema)
    assert sorted(r["item_id"] for r in drop_known(rows, history).collect()) == [11, 16, 17]
    assert drop_known(rows, history.limit(0)).count() == len(batch) and drop_known(rows.limit(0), history).count() == 0


def plain_nearest(rows, queries, k):
    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    return {(q, i) for q in queries for i in sorted(
        (i for i in rows if i != q), key=lambda i: (-round(max(0.0, cosine(rows[q], rows[i])), 9), i))[:k]}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_nearest_recall(spark, folder):
    units = unit_vectors(Tables(spark, f"/root/testdata/{folder}").embeddings, "vec_id", "embedding").cache()
    rows = {r["id"]: list(r["unit"]) for r in units.collect()}
    queries = [i for i in rows if i % 50 == 0]
    want = plain_nearest(rows, queries, 10)
    found = {(r["query_id"], r["id"]) for r in nearest(units.filter("id % 50 = 0"), units, 10, probes=12).collect()}
    assert len(found & want) >= 0.9 * len(want)
    exact = {(r["query_id"], r["id"]) for r in nearest(units.filter("id % 50 = 0"), units, 10).collect()}
    assert exact == want


def test_nearest_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 3.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, []),
            (8, [None, 1.0]), (9, [float("inf"), 1.0]), (10, [1.0, 0.0, 0.0])]
    units = unit_vectors(spark.createDataFrame(rows, "v int, e array<float>"), "v", "e")
    assert sorted(r["id"] for r in units.collect()) == [1, 2, 3, 10]
    got = [tuple(r) for r in nearest(units.filter("id = 1"), units, 2).orderBy("rank").collect()]
    assert got == [(1, 2, 1.0, 1), (1, 3, 0.0, 2)]
    assert nearest(units.limit(0), units.limit(0)).count() == 0


def test_nearest_copies_ties_and_lengths_in_blocks(spark, monkeypatch):
    from newsloom.operators import vectors
    monkeypatch.setattr(vectors, "UNIT_ROWS", 7)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 3)
    monkeypatch.setattr(vectors, "AT_A_TIME", 2)
    rows = [(i, [1.0, float(i % 4)]) for i in range(60)] + [(100 + i, [1.0, 0.0, float(i % 3)]) for i in range(9)] + [(200, [-1.0, -9.0])]
    units = unit_vectors(spark.createDataFrame(rows, "v int, e array<float>"), "v", "e")
    made = {r["id"]: list(r["unit"]) for r in units.collect()}
    got = nearest(units.filter("id % 5 = 0"), units, 4)
    want = set()
    for length in (2, 3):
        some = {i: v for i, v in made.items() if len(v) == length}
        want |= plain_nearest(some, [i for i in some if i % 5 == 0], 4)
    assert {(r["query_id"], r["id"]) for r in got.collect()} == want
    # Pairs stay in the tasks that count them: no plan joins vectors with queries.
    assert "CoGroups" in got._jdf.queryExecution().toString()
