"""Run monitoring, source health, batch validation, retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import windows
from newsloom.functions.text import strip
from newsloom.functions.times import freshness, moment, shift_hours

# Allowed state changes; a state without entry is final.
TRANSITIONS: dict[str, tuple[str, ...]] = {
    "queued": ("running", "cancelled", "interrupted"),
    "running": ("fetching", "failed", "cancelled", "interrupted"),
    "fetching": ("parsing", "failed", "cancelled", "interrupted"),
    "parsing": ("normalizing", "failed", "cancelled", "interrupted"),
    "normalizing": ("deduplicating", "failed", "cancelled", "interrupted"),
    "deduplicating": ("persisting", "failed", "cancelled", "interrupted"),
    "persisting": ("clustering", "failed", "cancelled", "interrupted"),
    "clustering": ("completed", "partial_failed", "failed", "cancelled", "interrupted"),
}
FINAL_STATES = ("completed", "partial_failed", "failed", "cancelled", "interrupted")
# Limits and messages.
HEALTH_RUNS, ERROR_STREAK, RETENTION_DAYS = 50, 3, 30
INTERRUPTED_MESSAGE = "Process restarted during execution"
REQUIRED_CONFIG = (
    ("source_url", "来源 URL"), ("selector_list", "列表项 Selector"),
    ("selector_title", "标题 Selector"), ("selector_link", "链接 Selector"),
)


def _run_order() -> Column:
    return F.struct("executed_at", "execution_id")


def history(executions: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    """One page of runs per task, newest first, with the task's total.

    The rank limit is applied before the shuffle, so a hot task sends one page per input task.
    """
    order = W.partitionBy("task_id").orderBy(F.col("executed_at").desc(), F.col("execution_id").desc())
    ranked = executions.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= page * per_page)
    totals = executions.groupBy("task_id").agg(F.count("*").alias("total"))
    return ranked.filter(F.col("position") > (page - 1) * per_page).join(totals, "task_id")


def latest_run(executions: DataFrame) -> DataFrame:
    kept = [c for c in executions.columns if c != "task_id"]
    return executions.groupBy("task_id").agg(F.max_by(F.struct(*kept), _run_order()).alias("r")).select("task_id", "r.*")


def sweep_stale(executions: DataFrame) -> DataFrame:
    """Runs still `running` after a restart become `interrupted`."""
    stale = F.col("status") == "running"
    return executions.withColumns({
        "status": F.when(stale, "interrupted").otherwise(F.col("status")),
        "error_message": F.when(stale, INTERRUPTED_MESSAGE).otherwise(F.col("error_message"))})


def can_transition(before: Column, after: Column) -> Column:
    ok = F.lit(False)
    for state, successors in TRANSITIONS.items():
        ok = ok | ((before == state) & after.isin(*successors))
    return ok


def check_transitions(run_events: DataFrame) -> DataFrame:
    """Each run event with the state before it, whether the change is allowed, and finality."""
    rows = windows.previous_value(run_events, ["execution_id"], ["created_at", "event_id"],
                                  windows.day("created_at"), "state", "previous_state")
    return rows.withColumns({
        "allowed": F.when(F.col("previous_state").isNull(), True)
        .otherwise(can_transition(F.col("previous_state"), F.col("state"))),
        "is_final": F.col("state").isin(*FINAL_STATES)})


def sequence_events(run_events: DataFrame) -> DataFrame:
    """Number the events of each run from 1 by arrival."""
    return windows.running(run_events, ["execution_id"], ["created_at", "event_id"],
                           windows.day("created_at"), {"seq": ("sum", F.lit(1))})


def replay_after(run_events: DataFrame, cursors: DataFrame, limit: int | None = None) -> DataFrame:
    """Events of a task after its cursor event (task_id, event_id), oldest first.

    With a `limit` a page of that many; the last event of a page is the cursor of the next one.

    Position is (time, id), so events of the same second are not lost. An unknown cursor
    replays nothing.
    """
    at = cursors.join(run_events, ["task_id", "event_id"]).select(
        "task_id", F.struct("created_at", "event_id").alias("_cursor"))
    later = run_events.join(at, "task_id").filter(F.struct("created_at", "event_id") > F.col("_cursor"))
    order = W.partitionBy("task_id").orderBy("created_at", "event_id")
    return later.drop("_cursor").withColumn("position", F.row_number().over(order)).filter(
        F.lit(True) if limit is None else F.col("position") <= limit)


def latest_events(run_events: DataFrame, by: str = "execution_id") -> DataFrame:
    kept = [c for c in run_events.columns if c != by]
    newest = F.max_by(F.struct(*kept), F.struct("created_at", "event_id"))
    return run_events.groupBy(by).agg(newest.alias("e")).select(by, "e.*")


def recent_events(run_events: DataFrame, by: str = "task_id", limit: int = 20) -> DataFrame:
    order = W.partitionBy(by).orderBy(F.col("created_at").desc(), F.col("event_id").desc())
    return run_events.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def streaks(executions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Failure and empty streaks per task after its last run, and the resulting status.

    A failure adds to the failure streak, any other run ends it; a non-empty success ends the
    empty streak, an empty one (`warning`) adds to it, a failure leaves it. Three failures in
    a row set `error`, which stays. Streaks are counted per stretch between resets.
    """
    failed, empty = F.col("status") == "failure", F.col("status") == "warning"
    rows = windows.running(
        executions.select("task_id", "status", "executed_at", "execution_id"),
        ["task_id"], ["executed_at", "execution_id"], windows.hour("executed_at"),
        {"stretch": ("sum", (~failed).cast("int")), "fill": ("sum", (~failed & ~empty).cast("int"))})
    parts = rows.groupBy("task_id", "stretch", "fill").agg(
        F.count_if(failed).alias("fails"), F.count_if(empty).alias("empties"), F.max("executed_at").alias("last"))
    per_stretch = parts.groupBy("task_id", "stretch").agg(F.sum("fails").alias("fails"))
    per_fill = parts.groupBy("task_id", "fill").agg(F.sum("empties").alias("empties"), F.max("last").alias("last"))
    fails = per_stretch.groupBy("task_id").agg(
        F.max_by("fails", "stretch").alias("consecutive_failures"), F.max("fails").alias("worst"))
    empties = per_fill.groupBy("task_id").agg(
        F.max_by("empties", "fill").alias("consecutive_empty"), F.max("last").alias("last_executed_at"))
    joined = fails.join(empties, "task_id").join(tasks.select("task_id", F.col("status").alias("_status")), "task_id", "left")
    return joined.select(
        "task_id", "consecutive_failures", "consecutive_empty", "last_executed_at",
        F.when(F.col("worst") >= ERROR_STREAK, "error").otherwise(F.col("_status")).alias("status"))


def run_status(error: Column, fetched: Column) -> Column:
    return F.when(error.isNotNull(), "failure").when(fetched == 0, "warning").otherwise("success")


def run_metrics(executions: DataFrame) -> DataFrame:
    """Per task and day: runs by status, items seen, created and deduplicated, duration."""
    status = run_status(F.col("error_message"), F.col("items_fetched"))
    return executions.groupBy("task_id", F.to_date("executed_at").alias("day")).agg(
        F.count("*").alias("runs"),
        *[F.count_if(status == s).alias(s) for s in ("success", "warning", "failure")],
        F.sum("items_fetched").alias("items_seen"), F.sum("items_new").alias("items_created"),
        F.sum(F.col("items_fetched") - F.col("items_new")).alias("items_deduped"),
        F.sum("duration_ms").alias("duration_ms"))


def duplicate_rate(executions: DataFrame) -> DataFrame:
    """Percent of fetched items that were not new, per task; nothing fetched gives 0."""
    fetched, new = F.sum("items_fetched"), F.sum("items_new")
    return executions.groupBy("task_id").agg(
        F.coalesce(F.try_divide((fetched - new) * 100.0, fetched), F.lit(0.0)).alias("duplicate_rate"))


def field_coverage(executions: DataFrame) -> DataFrame:
    """New / fetched of the latest success or warning run in percent, at most 100."""
    good = F.when(F.col("status").isin("success", "warning"), _run_order())
    last = executions.groupBy("task_id").agg(F.max_by(F.struct("items_fetched", "items_new"), good).alias("r"))
    share = F.try_divide(F.col("r.items_new") * 100.0, F.col("r.items_fetched"))
    return last.select("task_id", F.least(F.lit(100.0), F.coalesce(share, F.lit(0.0))).alias("field_coverage"))


def source_health(tasks: DataFrame, executions: DataFrame, as_of: str | datetime, runs: int = HEALTH_RUNS) -> DataFrame:
    """Health 0–100 per task from its last runs; a task that never ran is 0 / unknown."""
    order = W.partitionBy("task_id").orderBy(F.col("executed_at").desc(), F.col("execution_id").desc())
    recent = executions.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= runs)
    fetched, new = F.sum("items_fetched"), F.sum("items_new")
    facts = recent.groupBy("task_id").agg(
        F.count("*").alias("total_executions"),
        (F.count_if(F.col("status") != "failure") * 100.0 / F.count("*")).alias("http_availability"),
        (F.count_if(F.col("status").isin("success", "warning")) * 100.0 / F.count("*")).alias("parse_success_rate"),
        F.coalesce(F.try_divide((fetched - new) * 100.0, fetched), F.lit(0.0)).alias("duplicate_rate"),
        F.max("executed_at").alias("last_executed_at"))
    known = tasks.select("task_id").join(facts, "task_id", "left").join(field_coverage(executions), "task_id", "left")
    ran = F.col("total_executions").isNotNull()
    fresh = freshness(F.col("last_executed_at"), as_of)
    rows = known.withColumn("freshness", F.when(ran, fresh).otherwise(0.0))
    parts = ("http_availability", "parse_success_rate", "field_coverage", "duplicate_rate")
    rows = rows.withColumns({p: F.coalesce(F.col(p), F.lit(0.0)) for p in parts})
    score = F.when(ran, 0.30 * F.col("http_availability") + 0.30 * F.col("parse_success_rate")
                   + 0.20 * F.col("field_coverage") + 0.10 * F.col("freshness")
                   + 0.10 * (100 - F.col("duplicate_rate"))).otherwise(0.0)
    rows = rows.withColumn("_score", score)
    label = F.when(~ran, "unknown").when(F.col("_score") >= 80, "healthy").when(F.col("_score") >= 50, "degraded").otherwise("broken")
    return rows.select(
        "task_id", F.round("_score", 1).alias("health_score"), label.alias("status"),
        *[F.round(p, 1).alias(p) for p in ("http_availability", "parse_success_rate", "field_coverage", "freshness", "duplicate_rate")],
        F.coalesce("total_executions", F.lit(0)).alias("total_executions"), "last_executed_at")


def validate_batches(crawls: DataFrame, items: DataFrame, required: Sequence[str] = ("title", "link"),
                     min_items: int = 1, min_coverage: float = 0.9) -> DataFrame:
    """Three-layer check per crawl: transport (2xx), parse (any item), semantic (count and coverage)."""
    present = None
    for name in required:
        one = (F.coalesce(F.col(name).cast("string"), F.lit("")) != "").cast("int") if name in items.columns else F.lit(0)
        present = one if present is None else present + one
    counted = items.groupBy("crawl_id").agg(F.count("*").alias("items_found"), F.sum(present).alias("_present"))
    rows = crawls.join(counted, "crawl_id", "left").withColumn("items_found", F.coalesce("items_found", F.lit(0)))
    transport = F.col("http_status").between(200, 299)
    parsed = transport & (F.col("items_found") > 0)
    coverage = F.when(parsed, F.col("_present") / (F.col("items_found") * len(required))).otherwise(0.0)
    enough, covered = F.col("items_found") >= min_items, coverage >= min_coverage
    # Halves round to even in the message, as in common percent formatting.
    percent = F.format_string("Field coverage (%.1f%%) < minimum (%.1f%%)", F.bround(coverage * 100, 1), F.lit(min_coverage * 100))
    few = F.format_string("Items found (%d) < expected minimum (%d)", F.col("items_found"), F.lit(min_items))
    return rows.select(
        "crawl_id", "http_status", F.when(transport, F.col("items_found")).otherwise(0).alias("items_found"),
        F.round(coverage, 3).alias("field_coverage"),
        F.when(~transport, "transport_failed").when(~parsed, "parse_failed")
        .when(~(enough & covered), "semantic_failed").otherwise("valid").alias("status"),
        F.when(~transport, F.concat(F.lit("HTTP "), F.col("http_status").cast("string")))
        .when(~parsed, "No items extracted").alias("error"),
        F.when(parsed, F.array_compact(F.array(F.when(~enough, few), F.when(~covered, percent))))
        .otherwise(F.array().cast("array<string>")).alias("warnings"))


def missing_config(tasks: DataFrame, required: Sequence[tuple[str, str]] = REQUIRED_CONFIG) -> DataFrame:
    """Labels of required settings that are missing or blank, per task."""
    gaps = [F.when(strip(F.coalesce(F.col(name), F.lit(""))) == "", label) for name, label in required]
    return tasks.select("task_id", F.array_compact(F.array(*gaps)).alias("missing"))


def purge_expired(tasks: DataFrame, dependents: Mapping[str, DataFrame], as_of: str | datetime,
                  days: int = RETENTION_DAYS) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Drop tasks soft-deleted longer than `days` ago together with their dependent rows."""
    limit = shift_hours(moment(as_of), -24 * days)
    expired = F.coalesce(F.col("deleted_at") < limit, F.lit(False))
    gone = tasks.filter(expired).select("task_id")
    return tasks.filter(~expired), {k: v.join(gone, "task_id", "left_anti") for k, v in dependents.items()}


def rank_templates(templates: DataFrame, imports: DataFrame, category: str | None = None,
                   sort: str = "popular") -> DataFrame:
    """Shared templates with their number of imports, sorted by popularity, age or name."""
    rows = templates if category is None else templates.filter(F.col("category") == category)
    shares = imports.groupBy("template_id").agg(F.count("*").alias("share_count"))
    rows = rows.join(shares, "template_id", "left").withColumn("share_count", F.coalesce("share_count", F.lit(0)))
    order = {
        "popular": [F.col("share_count").desc(), F.col("created_seq").desc()],
        "recent": [F.col("created_seq").desc()],
        "name": [F.col("name").asc(), F.col("created_seq").asc()],
    }.get(sort, [F.col("share_count").desc(), F.col("created_seq").desc()])
    return rows.orderBy(*order)
