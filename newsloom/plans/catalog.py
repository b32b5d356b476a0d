"""Load every query module and expose the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.plans import cluster_plans, monitor_plans, recommend_plans, source_plans, stream_plans, text_plans, thread_plans  # noqa: F401
from newsloom.plans.registry import CHECKS, QUERIES, runnable


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runnable(name) for name in QUERIES}


def all_checks() -> dict[str, str]:
    return dict(CHECKS)
