"""Thread hotness and momentum.

Hotness adds, over the sources of a thread, 2^(-age/24h) of that source's newest item; items
older than 48 h add nothing. Many items of one source therefore count once.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.times import hours_between, moment, shift_hours

# Fixed values.
HALF_LIFE_HOURS, WINDOW_HOURS, TREND_HOURS = 24.0, 48.0, 24.0


def heat(latest: Column, at: Column) -> Column:
    """Contribution of one source whose newest item is `latest`; a future time counts as now."""
    age = hours_between(at, latest)
    return F.when(age <= WINDOW_HOURS, F.pow(F.lit(2.0), -F.greatest(age, F.lit(0.0)) / HALF_LIFE_HOURS)).otherwise(0.0)


def momentum(members: DataFrame, as_of: str | datetime, trend_hours: float = TREND_HOURS,
             source: str = "task_id") -> DataFrame:
    """thread_id, hotness, previous, delta: now and `trend_hours` ago, from one pass.

    Two partial aggregations: newest item per (thread, source), then the sum per thread.
    """
    now = moment(as_of)
    cutoff = shift_hours(now, -trend_hours)
    per_source = members.groupBy("thread_id", source).agg(
        F.max("fetched_at").alias("latest"),
        F.max(F.when(F.col("fetched_at") <= cutoff, F.col("fetched_at"))).alias("latest_then"))
    per_thread = per_source.groupBy("thread_id").agg(
        F.round(F.sum(F.coalesce(heat(F.col("latest"), now), F.lit(0.0))), 4).alias("hotness"),
        F.round(F.sum(F.coalesce(heat(F.col("latest_then"), cutoff), F.lit(0.0))), 4).alias("previous"))
    return per_thread.withColumn("delta", F.round(F.col("hotness") - F.col("previous"), 4))


def hotness(members: DataFrame, as_of: str | datetime, source: str = "task_id") -> DataFrame:
    return momentum(members, as_of, source=source).select("thread_id", "hotness")
