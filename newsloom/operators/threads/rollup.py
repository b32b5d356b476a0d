"""Thread rows from members, profiles, timelines, lists and digest prompts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.labels import confidence
from newsloom.functions.text import strip
from newsloom.functions.times import hours_between, micros, moment, shift_hours
from newsloom.operators.threads.hotness import heat, momentum
from newsloom.operators.threads.relations import relation_summary

SEED_REASON = "initial_item"
# Digest limits and prompt lines.
DIGEST_MIN_ITEMS, DIGEST_ITEMS, DIGEST_SUMMARY = 2, 10, 300
PROMPT_TITLE, PROMPT_MATERIAL, PROMPT_SUMMARY, UNKNOWN_SOURCE = "事件标题：", "报道材料：", "   摘要：", "未知来源"


def roll_up(members: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row per thread: item count, sources, longest title (earliest on a tie), first and last time.

    A repeated (thread, item) pair counts once. With `names` (task_id, name) the platforms are
    source names, else task ids.
    """
    rows = members.dropDuplicates(["thread_id", "item_id"])
    platform = F.col("task_id")
    if names is not None:
        rows = rows.join(names.select("task_id", F.col("name").alias("_platform")), "task_id", "left")
        platform = F.col("_platform")
    title_rank = F.struct(F.length("title"), -micros(F.col("fetched_at")), -F.col("item_id"))
    return rows.groupBy("thread_id").agg(
        F.count("*").alias("item_count"),
        F.sort_array(F.collect_set(platform)).alias("platforms"),
        F.max_by("title", title_rank).alias("title"),
        F.min("fetched_at").alias("first_seen_at"),
        F.max("fetched_at").alias("last_seen_at"))


def seeds(members: DataFrame) -> DataFrame:
    """Seed items of each thread: the marked ones, or the earliest item when none is marked.

    Thread-level facts come from one partial aggregate; no window holds a whole thread.
    """
    marked = F.coalesce(F.col("match_reason") == SEED_REASON, F.lit(False))
    order = F.struct(F.col("fetched_at").isNull(), F.col("fetched_at"), F.col("item_id"))
    facts = members.groupBy("thread_id").agg(
        F.max(marked).alias("_has_mark"), F.min_by("item_id", order).alias("_first"))
    return members.join(facts, "thread_id").withColumn(
        "is_seed", F.when(F.col("_has_mark"), marked).otherwise(F.col("item_id") == F.col("_first"))
    ).drop("_has_mark", "_first")


def profile(members: DataFrame, names: DataFrame, as_of: str | datetime) -> DataFrame:
    """Why the items form one thread: size, sources, activity, match quality, hotness.

    Seeds define a thread and say nothing about match quality, so they are left out of it.
    Level one aggregates per (thread, source name), level two per thread.
    """
    now = moment(as_of)
    named = seeds(members).join(names.select("task_id", "name"), "task_id", "left")
    platform = F.when(F.coalesce(F.col("name"), F.lit("")) == "", "unknown").otherwise(F.col("name"))
    similarity = F.when(~F.col("is_seed"), F.col("similarity"))
    per_source = named.groupBy("thread_id", platform.alias("platform")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("fetched_at") >= shift_hours(now, -6)).alias("n6"),
        F.count_if(F.col("fetched_at") >= shift_hours(now, -24)).alias("n24"),
        F.count(similarity).alias("matched"),
        F.sum(similarity).alias("similarity_sum"),
        F.max(similarity).alias("similarity_max"),
        F.min("fetched_at").alias("first"),
        F.max("fetched_at").alias("last"))
    whole = per_source.groupBy("thread_id").agg(
        F.sum("n").alias("item_count"),
        F.count("*").alias("platform_count"),
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("rank"), F.col("platform")))).alias("_sources"),
        F.sum("n6").alias("recent_6h_count"),
        F.sum("n24").alias("recent_24h_count"),
        F.round(hours_between(F.max("last"), F.min("first")), 1).alias("span_hours"),
        F.sum("matched").alias("matched_item_count"),
        F.round(F.try_divide(F.sum("similarity_sum"), F.sum("matched")), 4).alias("similarity_avg"),
        F.round(F.max("similarity_max"), 4).alias("similarity_max"),
        F.round(F.sum(F.coalesce(heat(F.col("last"), now), F.lit(0.0))), 4).alias("hotness"))
    return whole.withColumns({
        "platform_breakdown": F.transform("_sources", lambda s: F.struct(
            s["platform"].alias("platform"), (-s["rank"]).alias("count"))),
        "confidence": confidence(F.col("similarity_avg")),
        "is_cross_platform": F.col("platform_count") > 1,
    }).drop("_sources")


def timeline(members: DataFrame, names: DataFrame, thread_id: str | None = None) -> DataFrame:
    """Members newest first with source name, similarity and reason; one thread or all."""
    rows = members if thread_id is None else members.filter(F.col("thread_id") == thread_id)
    named = rows.join(names.select("task_id", F.col("name").alias("task_name")), "task_id", "left")
    return named.select("thread_id", "item_id", "title", "task_name", "fetched_at", "similarity", "match_reason") \
        .orderBy("thread_id", F.col("fetched_at").desc(), F.col("item_id").desc())


def thread_list(threads: DataFrame, members: DataFrame, relations: DataFrame, as_of: str | datetime,
                sort: str = "first_seen", task_id: str | None = None, page: int = 1,
                per_page: int = 20) -> DataFrame:
    """A page of threads that still have items, with momentum, relation summary and total.

    Sorting by first_seen limits first and aggregates only the page's threads; sorting by
    hotness has to rate all of them.
    """
    live = members if task_id is None else members.filter(F.col("task_id") == task_id)
    listed = threads.join(live.select("thread_id"), "thread_id", "left_semi")
    total = listed.agg(F.count("*").alias("n")).scalar()
    offset = (page - 1) * per_page
    if sort == "first_seen":
        listed = listed.orderBy(F.col("first_seen_at").desc(), F.col("thread_id").desc()).offset(offset).limit(per_page)
        members = members.join(listed.select("thread_id"), "thread_id", "left_semi")
    rated = listed.join(momentum(members, as_of), "thread_id", "left")
    rated = rated.fillna(0.0, subset=["hotness", "previous", "delta"])
    if sort == "hotness":
        order = [F.col("hotness").desc(), F.col("last_seen_at").desc(), F.col("thread_id").desc()]
        rated = rated.orderBy(*order).offset(offset).limit(per_page)
    summary = relation_summary(relations, threads.select("thread_id", "title"))
    out = rated.join(summary, "thread_id", "left").withColumn("total", total)
    return out.withColumn("related_count", F.coalesce("related_count", F.lit(0)))


def drop_items(members: DataFrame, interactions: DataFrame, deleted: DataFrame,
               names: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete items: (remaining members, thread rows, remaining interactions). Empty threads vanish."""
    gone = deleted.select("item_id")
    left = members.join(gone, "item_id", "left_anti")
    return left, roll_up(left, names), interactions.join(gone, "item_id", "left_anti")


def digest_prompts(threads: DataFrame, members: DataFrame, items: DataFrame, names: DataFrame,
                   digests: DataFrame | None = None) -> DataFrame:
    """Prompt text per thread with at least two items and no digest, from its ten newest items."""
    todo = threads.filter(F.col("item_count") >= DIGEST_MIN_ITEMS)
    if digests is not None:
        todo = todo.join(digests.filter(F.col("digest") != "").select("thread_id"), "thread_id", "left_anti")
    newest = W.partitionBy("thread_id").orderBy(F.col("fetched_at").desc(), F.col("item_id").desc())
    top = members.join(todo.select("thread_id"), "thread_id", "left_semi") \
        .withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= DIGEST_ITEMS)
    rows = top.select("thread_id", "item_id", "task_id", "title", "n") \
        .join(items.select("item_id", "summary"), "item_id", "left") \
        .join(names.select("task_id", "name"), "task_id", "left")
    source = F.when(F.coalesce(F.col("name"), F.lit("")) == "", UNKNOWN_SOURCE).otherwise(F.col("name"))
    brief = F.substring(strip(F.coalesce("summary", F.lit(""))), 1, DIGEST_SUMMARY)
    line = F.concat(F.col("n").cast("string"), F.lit(". ["), source, F.lit("] "), strip(F.coalesce("title", F.lit(""))),
                    F.when(brief != "", F.concat(F.lit(f"\n{PROMPT_SUMMARY}"), brief)).otherwise(""))
    texts = rows.groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda r: r["line"]), "\n")
    return texts.join(todo.select("thread_id", "title"), "thread_id").select(
        "thread_id", F.concat(F.lit(PROMPT_TITLE), F.col("title"), F.lit(f"\n\n{PROMPT_MATERIAL}\n"), body).alias("prompt"))
