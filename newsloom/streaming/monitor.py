"""Live run monitor, sweep of silent runs, and streaming streak counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.functions import windows
from newsloom.operators.monitor import ERROR_STREAK, FINAL_STATES, INTERRUPTED_MESSAGE
from newsloom.streaming.tables import AppendTable, StateTable, each_batch

STREAK_SCHEMA = ("task_id string, consecutive_failures bigint, consecutive_empty bigint, "
                 "reached_error boolean, last_executed_at timestamp_ntz")
MONITOR_SCHEMA = "task_id string, state string, last_event_id bigint, updated_at timestamp, events bigint, is_final boolean"


def live_runs(events: DataFrame) -> DataFrame:
    """Streaming aggregate: latest state, event count and finality per task.

    A plain stateful aggregate: map-side combined, state holds one row per task.
    """
    order = F.struct("created_at", "event_id")
    state = events.groupBy("task_id").agg(
        F.max_by("state", order).alias("state"), F.max_by("event_id", order).alias("last_event_id"),
        F.max("created_at").alias("updated_at"), F.count("*").alias("events"))
    return state.withColumn("is_final", F.col("state").isin(*FINAL_STATES))


def monitor_runs(events: DataFrame, table: AppendTable, checkpoint: str) -> StreamingQuery:
    """Append the tasks that a batch touched; Spark's state store holds the aggregate.

    Late events count and change the latest state only if they are the latest, so no row is dropped.
    """
    return each_batch(live_runs(events), checkpoint, lambda df, epoch: table.write(df, epoch), mode="update")


def current_runs(table: AppendTable) -> DataFrame:
    """One row per task: event counts only grow, so of several versions the one with most events is the last."""
    rows = table.read()
    return rows.groupBy("task_id").agg(F.max_by(F.struct(*rows.columns), "events").alias("r")).select("r.*")


SILENT_SCHEMA = "execution_id string, last_event_id bigint, state string, silent_since timestamp, error_message string"
SILENT_HOURS, DELAY = 1.0, "1 hour"


def silent_runs(events: DataFrame, hours: float = SILENT_HOURS, delay: str = DELAY) -> DataFrame:
    """Runs that are not final and had no event for `hours`, as a stream: one row for each such silence.

    `events`: execution_id, event_id, state, created_at. An event-time timer waits for each open run;
    it fires when the watermark, `delay` behind the newest event, has passed. A run that goes on later may fall
    silent again. Events behind the watermark are left out, as Spark does for all timers.
    """
    limit = pd.Timedelta(hours=hours)

    def row(key: tuple, last: tuple) -> pd.DataFrame:
        return pd.DataFrame({"execution_id": [key[0]], "last_event_id": [last[1]], "state": [last[2]],
                             "silent_since": [pd.Timestamp(last[0])], "error_message": [INTERRUPTED_MESSAGE]})

    def watch(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield row(key, state.get)
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["created_at", "event_id"])
        for at, number, name in zip(rows["created_at"], rows["event_id"], rows["state"], strict=True):
            if last is not None and at - pd.Timestamp(last[0]) > limit:
                yield row(key, last)
            if last is None or at >= pd.Timestamp(last[0]):
                last = None if name in FINAL_STATES else (at.to_pydatetime(), int(number), name)
        if last is None:
            if state.exists:
                state.remove()
            return
        state.update(last)
        state.setTimeoutTimestamp(max(int((pd.Timestamp(last[0]) + limit).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    narrow = events.select("execution_id", "event_id", "state", F.col("created_at").cast("timestamp").alias("created_at"))
    return narrow.withWatermark("created_at", delay).groupBy("execution_id").applyInPandasWithState(
        watch, SILENT_SCHEMA, "at timestamp, event_id bigint, state string", "append", GroupStateTimeout.EventTimeTimeout)


def sweep_runs(events: DataFrame, table: AppendTable, checkpoint: str) -> StreamingQuery:
    """Append the runs that fall silent."""
    return each_batch(silent_runs(events), checkpoint, lambda df, epoch: table.write(df, epoch))


def fold_streaks(batch: DataFrame, before: DataFrame) -> DataFrame:
    """Streak state after a batch of runs.

    The batch is cut into stretches between resets with bucketed running counts; only its first
    stretch continues the streak held in the state.
    """
    failed, empty = F.col("status") == "failure", F.col("status") == "warning"
    rows = windows.running(
        batch.select("task_id", "status", "executed_at", "execution_id"),
        ["task_id"], ["executed_at", "execution_id"], windows.hour("executed_at"),
        {"stretch": ("sum", (~failed).cast("int")), "fill": ("sum", (~failed & ~empty).cast("int"))})
    parts = rows.groupBy("task_id", "stretch", "fill").agg(
        F.count_if(failed).alias("fails"), F.count_if(empty).alias("empties"), F.max("executed_at").alias("last"))
    stretches = parts.groupBy("task_id", "stretch").agg(F.sum("fails").alias("fails"))
    fills = parts.groupBy("task_id", "fill").agg(F.sum("empties").alias("empties"), F.max("last").alias("last"))
    fails = stretches.groupBy("task_id").agg(
        F.max("stretch").alias("last_stretch"), F.max_by("fails", "stretch").alias("tail_fails"),
        F.max(F.when(F.col("stretch") == 0, F.col("fails"))).alias("head_fails"), F.max("fails").alias("worst"))
    empties = fills.groupBy("task_id").agg(
        F.max("fill").alias("last_fill"), F.max_by("empties", "fill").alias("tail_empties"), F.max("last").alias("last"))
    joined = before.join(fails.join(empties, "task_id"), "task_id", "full")
    held_fails, held_empty = F.coalesce("consecutive_failures", F.lit(0)), F.coalesce("consecutive_empty", F.lit(0))
    head = F.coalesce(F.col("head_fails"), F.lit(0)) + held_fails
    touched = F.col("tail_fails").isNotNull()
    return joined.select(
        "task_id",
        F.when(~touched, held_fails).when(F.col("last_stretch") == 0, head).otherwise(F.col("tail_fails")).alias("consecutive_failures"),
        F.when(~touched, held_empty).when(F.col("last_fill") == 0, held_empty + F.col("tail_empties"))
        .otherwise(F.col("tail_empties")).alias("consecutive_empty"),
        (F.coalesce("reached_error", F.lit(False)) | F.coalesce(F.greatest("worst", head) >= ERROR_STREAK, F.lit(False))).alias("reached_error"),
        F.greatest("last_executed_at", "last").alias("last_executed_at"))


def stream_streaks(runs: DataFrame, table: StateTable, checkpoint: str) -> StreamingQuery:
    return each_batch(runs, checkpoint, lambda df, epoch: table.write(fold_streaks(df, table.version(epoch - 1)), epoch))
