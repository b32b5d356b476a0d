"""Dashboard aggregates. Every query names its clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.times import moment, shift_hours

WEEK_HOURS = 7 * 24


def totals(items: DataFrame, executions: DataFrame, threads: DataFrame, as_of: str | datetime) -> DataFrame:
    """One row: items, items today, executions today, threads. Each table is read once."""
    today = F.to_date(moment(as_of))
    counted = items.agg(F.count("*").alias("total_items"),
                        F.count_if(F.to_date("fetched_at") == today).alias("items_today"))
    runs = executions.agg(F.count_if(F.to_date("executed_at") == today).alias("n")).scalar()
    return counted.withColumns({"executions_today": runs, "total_threads": threads.agg(F.count("*").alias("n")).scalar()})


def task_status(tasks: DataFrame) -> DataFrame:
    """Live sources by status, one row."""
    live = tasks.filter(F.col("deleted_at").isNull())
    return live.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("active", "paused", "error")],
                    F.count("*").alias("total"))


def success_rate(executions: DataFrame, as_of: str | datetime) -> DataFrame:
    """Seven-day success rate; warnings count in the denominator, no runs give NULL."""
    recent = executions.filter(F.col("executed_at") >= shift_hours(moment(as_of), -WEEK_HOURS))
    good = F.count_if(F.col("status") == "success")
    return recent.agg(
        F.count("*").alias("total_executions"), F.count_if(F.col("status") == "failure").alias("failures"),
        F.round(F.try_divide(good, F.count("*")), 3).alias("success_rate"))


def daily_items(items: DataFrame, as_of: str | datetime) -> DataFrame:
    recent = items.filter(F.col("fetched_at") >= shift_hours(moment(as_of), -WEEK_HOURS))
    return recent.groupBy(F.to_date("fetched_at").alias("day")).agg(F.count("*").alias("items"))


def filled_week(items: DataFrame, as_of: str | datetime) -> DataFrame:
    """The seven days ending today with zeros for empty days, plus total and peak day (first maximum)."""
    today = F.to_date(moment(as_of))
    days = items.sparkSession.range(7).select(F.date_sub(today, F.col("id").cast("int")).alias("day"))
    series = days.join(daily_items(items, as_of), "day", "left").select("day", F.coalesce("items", F.lit(0)).alias("items"))
    total = series.agg(F.sum("items").alias("n")).scalar()
    peak = series.agg(F.min_by("day", F.struct((-F.col("items")).alias("n"), "day")).alias("d")).scalar()
    return series.withColumns({"week_total": total, "peak_day": peak})


def top_sources(tasks: DataFrame, items: DataFrame, as_of: str | datetime, limit: int = 5) -> DataFrame:
    """Live sources by items of the last seven days; a source without items keeps a zero.

    Items are counted before the join, so it moves one row per source.
    """
    recent = items.filter(F.col("fetched_at") >= shift_hours(moment(as_of), -WEEK_HOURS))
    counted = recent.groupBy("task_id").agg(F.count("*").alias("n"))
    live = tasks.filter(F.col("deleted_at").isNull()).select("task_id", "name")
    return live.join(counted, "task_id", "left").select("task_id", "name", F.coalesce("n", F.lit(0)).alias("item_count")) \
        .orderBy(F.col("item_count").desc(), "task_id").limit(limit)
