"""Every vector asks, and every vector may answer."""

from __future__ import annotations

import pytest

from newsloom.operators.vectors import unit_vectors
from newsloom.plans import text_plans
from newsloom.plans.fixtures import Tables
from tests.test_keys_and_vectors import plain_nearest


@pytest.mark.parametrize("query", [text_plans.u01, text_plans.u01_exact])
def test_nearest_queries_ask_with_all_vectors(spark, tmp_path, query):
    rows = [(i, [float(i * 37 % 11) - 5, float(i * 53 % 7) - 3, float(i * 29 % 13) - 6]) for i in range(1, 120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    t = Tables(spark, str(tmp_path))
    made = {r["id"]: list(r["unit"]) for r in unit_vectors(t.embeddings, "vec_id", "embedding").collect()}
    found = query(t).collect()
    assert {(r["query_id"], r["id"]) for r in found} == plain_nearest(made, list(made), 10)
    assert len(found) == 10 * len(made)
