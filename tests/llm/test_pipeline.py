"""The pipeline's stages, each against a brute-force version on its own input."""

from __future__ import annotations

import random

import corpus_pipeline
from newsloom.llm import queries as registered
from newsloom.llm import toxicity
from newsloom.llm.common import new_folder, written
from tests.llm import brute
from tests.llm.conftest import ODD

COLUMNS = {"doc_id", "text", "lang", "source", "n_chars"}


def _tables(spark, folder):
    """The smallest tables with odd rows and a few copies, in a folder of their own."""
    where, draw = new_folder(spark, "tables"), random.Random(1)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    more = [(10_000 + i, t, "en", None, 0) for i, (_, t) in enumerate(ODD)]
    for i, (_, text) in enumerate(rows[:20]):
        words = text.split()
        words[draw.randrange(len(words))] = "edited"
        more.append((20_000 + i, " ".join(words), "en", "s", 0))
    spark.createDataFrame(more, docs.schema).unionByName(docs).repartition(3).write.parquet(f"{where}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{where}/{name}.parquet")
    return where


def test_stages(spark, folder):
    where = _tables(spark, folder)
    docs = registered.table(spark, where, "documents")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        after = written(stage(spark, docs, where), "stage")
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        if name == "toxicity":
            scored = toxicity.toxic_scores(docs, spark.read.parquet(f"{where}/labels.parquet"))
            want = {r["doc_id"] for r in scored.filter("predicted = 0").collect()}
            assert len(want) < len(rows)
        elif name == "exact dedup":
            want = {k for k, v in brute.exact(rows).items() if v[2]}
        elif name == "minhash near dedup":
            want = {k for k, v in brute.near(rows, 5, 80).items() if v[2]}
        elif name == "benchmark decontamination":
            want = {k for k, v in brute.leaks(rows, items).items() if not v}
        else:
            coded = brute.library_ids(rows, "word_bpe_49k.json", [2])
            want = set(coded)
            assert sum(r["length"] for r in after.collect()) == sum(map(len, coded.values()))
        assert kept == want, name
        assert name == "packing" or (set(after.columns) == COLUMNS and after.count() == len(want))
        docs = after


def test_run_is_its_stages(spark, folder):
    docs = registered.table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), "stage")
    columns = sorted(docs.columns)
    a, b = (sorted(tuple(r) for r in x.select(*columns).collect()) for x in (docs, corpus_pipeline.run(spark, folder)))
    assert sum(r[columns.index("length")] for r in a) == sum(r[columns.index("length")] for r in b)
    assert len({r[columns.index("doc_id")] for r in b}) == len({r[columns.index("doc_id")] for r in a})
