from __future__ import annotations

import pytest

from newsloom.llm.common import tuned

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with internal ones."""
    def make(rows):
        full = [(k, t, "en", None if i % 3 == 0 else f"s{i % 2}", len(t or "")) for i, (k, t) in enumerate(rows)]
        made = tuned(spark).createDataFrame(full, SCHEMA)
        return made.selectExpr("*", "1 AS k", "'x' AS t", "2 AS n", "'y' AS key", "3 AS label", "4 AS _k", "5 AS h", "6 AS start")
    return make


@pytest.fixture(scope="session")
def corpus(spark, folder):
    """(doc_id, text) of the smallest table."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


LONG = " ".join(f"w{i * 7919 % 9973}" for i in range(6000))
# Two words that meet under every polynomial hash modulo a power of two: Thue-Morse and its complement.
TWINS = tuple("".join("ab"[(bin(i).count("1") + j) % 2] for i in range(1024)) for j in range(2))
_COMMON = " ".join(f"u{i}" for i in range(19))
ODD = [
    (21, f"{_COMMON} {TWINS[0]}"), (22, f"{_COMMON} {TWINS[1]}"), (23, f"{TWINS[0]} {TWINS[1]} {TWINS[0]}"),
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One "), (6, "one two"), (7, LONG), (8, LONG + " tail"),
    (9, "a " * 60), (10, "a b " * 40), (11, "same words here " * 9), (12, "same words here " * 9), (13, "x\u0000y <|endoftext|> z"),
    (14, "ÉÈ 漢字 текст é ﬁ"), (15, LONG[3000:9000]), (None, "no key"), (None, "no key"), (None, None),
]
