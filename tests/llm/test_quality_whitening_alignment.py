"""Quality rules, embedding whitening and token alignment against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import alignment, quality, queries, whitening
from tests.llm import brute
from tests.llm.conftest import ODD

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
TABLES = (queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER)


# --- quality rules --------------------------------------------------------------------------------

def test_quality_counts(spark, docs, corpus):
    rows = corpus + [(10_000 + i, t) for i, (_, t) in enumerate(ODD)] + [
        (-1, "a\n\na\n a\na"), (-2, "\n\n"), (-3, "x " * 30), (-4, "é# \u2028\x85x"), (-5, "a b c d e f g h " * 2)]
    got = {r["doc_id"]: r for r in quality.judged(docs(rows)).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        assert tuple(got[k][c] for c in BASE) == brute.quality(text), k
        assert not (got[k]["kept"] and got[k]["base_failed"])


def test_quality_random_lines_and_windows():
    draw = random.Random(5)
    texts = ["".join(draw.choice("ab \n\n  é#") for _ in range(draw.randint(0, 90))) for _ in range(2000)]
    got = quality.counted(pa.array([*texts, None]), quality.Rules())
    assert list(zip(*(got[c].tolist() for c in BASE), strict=True)) == [brute.quality(t) for t in [*texts, None]]


def test_quality_bands():
    draw, rules = random.Random(6), quality.Rules()
    vocabulary = ["".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 9))) for _ in range(4000)]
    prose = [" ".join(draw.choices(vocabulary, k=n)) for n in (40, 200, 2000, 40_000)]
    noise = ["".join(chr(draw.randint(33, 126)) if i % 6 else " " for i in range(n)) for n in (1200, 5000, 60_000)]
    # Every window of eight words differs, though the text is made of one sentence.
    turns = [" ".join(f"the same old sentence comes again with number {i % 90}" for i in range(n)) for n in (90, 2000)]
    sparse = " ".join(f"{x} {i}" for i in range(300) for x in ("alpha", "beta", "gamma", "delta", "epsilon"))
    got = quality.counted(pa.array([*prose, *noise, *turns, sparse]), rules)
    assert got["kept"].tolist() == [True] * 4 + [False] * 6
    assert not got["base_failed"][4:7].any() and not got["base_failed"][-1]
    # A text within its band that holds a long repetitive part is told by its chunks.
    mixed = pa.array([prose[3][:20_000] + " " + " ".join(f"{x} {i}" for i in range(600) for x in ("alpha", "beta", "gamma"))])
    assert quality.counted(mixed, rules)["bad_share"][0] > 0
    assert quality.compression(b"", rules, None) == (None, 0.0, True)


def test_quality_odd_rows(spark, docs):
    frame = docs([*ODD, (None, "no key")])
    assert quality.judged(frame).count() == len(ODD) + 1
    assert quality.judged(docs([(1, None)]).limit(0)).count() == 0
    kept = quality.drop_poor(frame)
    assert kept.columns == frame.columns and kept.schema == frame.schema
    want = sorted(r["doc_id"] for r in quality.judged(frame).filter("kept").collect() if r["doc_id"] is not None)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == want


# --- whitening ------------------------------------------------------------------------------------

@pytest.fixture(scope="session")
def vectors(spark):
    def make(rows):
        return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
            "*", "1 AS k", "2 AS x", "3 AS i", "4 AS n", "5 AS component")
    return make


def held(frame, rows, components=16):
    got = {(r["vec_id"], r["component"]): r for r in frame.collect()}
    used, want, n = brute.whitening(rows, components)
    assert got.keys() == want.keys() and {k for k, _ in got} == used.keys()
    signs = {}
    for at, (deviation, value, share) in want.items():
        r = got[at]
        assert r["deviation"] == deviation and r["n"] == n and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], share, rel_tol=1e-6)
        if abs(value) > 1e-6:
            sign = signs.setdefault(at[1], np.sign(value) * np.sign(r["whitened"]))
            assert abs(sign * r["whitened"] - value) < 1e-6
    return got


def test_whitening_of_the_table(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    held(queries.op11_embedding_whitening(spark, folder), rows)


def test_whitening_odd_vectors(vectors):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=5).tolist()) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]  # a third of all rows is one vector
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [math.nan] * 5), (203, [math.inf, 0.0, 0.0, 0.0, 0.0]),
           (204, [1e300] * 5), (205, []), (206, [1.0, 2.0])]
    held(whitening.whitened(vectors(rows + bad)), rows)
    again = whitening.whitened(vectors([*rows, *rows, (None, rows[1][1])]).repartition(7))
    assert again.count() == 5 * (2 * len(rows) + 1)
    assert again.filter("vec_id IS NULL").count() == 5


def test_whitening_without_variance(vectors):
    assert whitening.whitened(vectors([(1, [1.0, 2.0])] * 3)).count() == 0
    assert whitening.whitened(vectors([(1, None)])).count() == 0
    flat = [(i, [float(i), 2.0 * i, 3.0]) for i in range(6)]  # one direction only
    held(whitening.whitened(vectors(flat)), flat)


def test_whitening_of_large_entries_is_exact(vectors):
    draw = random.Random(9)
    rows = [(i, [draw.uniform(-1e9, 1e9), draw.uniform(-1, 1)]) for i in range(50)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(vectors(rows)).filter("component = 1").collect()}
    want = {k: d for (k, c), (d, _, _) in brute.whitening(rows)[1].items() if c == 1}
    assert got == {k: d if d < 2 ** 63 else None for k, d in want.items()}


def test_jacobi_equals_eigh():
    draw = np.random.default_rng(4)
    for size, rank in ((1, 1), (2, 2), (7, 7), (9, 4), (64, 64)):
        root = draw.normal(size=(size, rank))
        values, vectors_ = whitening.one_sided_jacobi(whitening.pivoted_cholesky(root @ root.T))
        assert len(values) == rank and np.all(np.diff(values) <= 0)
        assert np.allclose(values, np.linalg.eigvalsh(root @ root.T)[::-1][:rank], rtol=1e-9)
        assert np.allclose(vectors_.T @ vectors_, np.eye(rank), atol=1e-12)
        assert np.allclose(vectors_ * values @ vectors_.T, root @ root.T, atol=1e-9 * values[0])


# --- alignment ------------------------------------------------------------------------------------

RESULT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TRICKY = ["  a  b", "▁x", "<s> <unk> <|endoftext|> </s>", "漢字 ﬁ", "a\n\nb c", " ", " x", "don't  stop  ", "é" * 50, "ab" * 3000,
          "x\u0000y", "tab\ttab", "e\u0301 \u00a0z", "👩‍👩‍👧 ok"]


def test_alignment_equals_brute_force(docs, corpus):
    rows = corpus[:120] + [(10_000 + i, t) for i, t in enumerate(TRICKY)] + [
        (20_000 + i, t) for i, (_, t) in enumerate(ODD)]
    got = {r["doc_id"]: tuple(r[c] for c in RESULT) for r in alignment.alignments(docs(rows).repartition(3), *TABLES).collect()}
    assert got == brute.alignment(rows)
    assert any(v[0] == 0 for v in got.values()) and any(v[4] < v[3] for v in got.values())


def test_alignment_of_the_table(spark, folder, corpus):
    got = {r["doc_id"]: tuple(r[c] for c in RESULT) for r in queries.op12_token_alignment(spark, folder).collect()}
    assert got == brute.alignment(corpus)


def test_alignment_memo_may_be_emptied(corpus, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_WINDOWS", 5)
    both = alignment.Pair(*TABLES)
    texts = pa.array([t for _, t in corpus[:30]])
    first, _ = alignment._batch(pa.array(range(30)), texts, both)
    second, _ = alignment._batch(pa.array(range(30)), texts, both)
    assert first.drop_columns(["batch"]).equals(second.drop_columns(["batch"]))


def test_alignment_odd_rows(docs):
    assert alignment.alignments(docs([(1, "a")]).limit(0), *TABLES).count() == 0
    rows = docs([(1, None), (1, ""), (None, "a b"), (None, "a b"), (2, "a b")])
    got = sorted(((r["doc_id"], r["n_a"], r["count_sum"]) for r in alignment.alignments(rows, *TABLES).collect()), key=str)
    assert got == [(1, 0, 0), (1, 0, 0), (2, 2, 6), (None, 2, 6), (None, 2, 6)]


def test_alignment_groups_cover_the_text(docs):
    texts = {1: "The quick brown fox, naïve 漢字.", 2: "a\nb"}
    found = alignment.groups(docs(list(texts.items())), *TABLES).orderBy("doc_id", "group").collect()
    for k, text in texts.items():
        mine = [r for r in found if r["doc_id"] == k]
        assert mine[0]["start"] == -1 and mine[-1]["end"] == len(text.encode())
        assert all(x["end"] == y["start"] for x, y in zip(mine[:-1], mine[1:], strict=True))
        assert all(r["a"] and r["b"] for r in mine)
