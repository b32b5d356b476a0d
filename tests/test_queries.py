"""Every registered query against its DuckDB check, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from newsloom.plans.catalog import all_checks, all_queries
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = all_queries(), all_checks()
# Queries that are rows-only by design.
UNCHECKED = {"f15_repository_entities"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_contract():
    assert set(CHECKS) == set(QUERIES) - UNCHECKED
    assert set(QUERIES) <= set(contract.queries()) and set(CHECKS) <= set(contract.oracle_sql())
    assert len(QUERIES) > 140


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, rows, _ = compare(name, spark, FOLDER, con, QUERIES, CHECKS)
    assert problem is None
    assert rows > 0 or name == "t07_storyline_relations"
