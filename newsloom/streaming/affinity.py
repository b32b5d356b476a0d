"""Streaming affinity: updates in any order, folded hour by hour.

An update maps a score s to 0.9·s + 0.1·d, so the updates of an hour together are one affine map. One row
per key and hour holds that map; the score is the chain of the maps. An update that comes late folds
its own hour again from the log and leaves all others as they are, so no update is set aside.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions import windows
from newsloom.operators.recommend import chain_hours, fold_hours
from newsloom.streaming.tables import AppendTable, each_batch

BY = ("user_id",)
DELTA_SCHEMA = "interaction_id bigint, user_id bigint, created_at timestamp_ntz, affinity_type string, affinity_value string, delta double"
HOUR_SCHEMA = ("user_id bigint, affinity_type string, affinity_value string, _bucket timestamp_ntz, "
               "n bigint, part double, first_delta double, last timestamp_ntz")
DELTA_COLUMNS = ("interaction_id", "user_id", "created_at", "affinity_type", "affinity_value", "delta")


def _keys(by: Sequence[str]) -> list[str]:
    return [*by, "affinity_type", "affinity_value"]


def touched_hours(batch: DataFrame, log: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The hours that a batch touches, folded from the batch and the earlier updates in `log`.

    The log is read between the first and last hour of the batch only: a file's times tell whether it is
    opened, so a batch in order reads little more than the newest one. An update without a time comes before all others.
    """
    keys, hour = _keys(by), windows.hour("created_at").cast("timestamp_ntz")
    low, high = batch.agg(F.min(hour), F.max("created_at")).first()
    fresh = batch.select(*DELTA_COLUMNS).withColumn("_bucket", hour)
    if low is None:
        near = log.filter(F.col("created_at").isNull())
    else:
        first, last = (F.lit(str(at)).cast("timestamp_ntz") for at in (low, high + timedelta(hours=1)))
        near = log.filter(F.col("created_at").isNull() | F.col("created_at").between(first, last))
    held = near.select(*DELTA_COLUMNS).withColumn("_bucket", hour).alias("l")
    group = [*keys, "_bucket"]
    touched = fresh.select(*group).distinct().alias("t")
    same = F.lit(True)
    for k in group:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"t.{k}"))
    return fold_hours(fresh.unionByName(held.join(touched, same, "left_semi")), keys)


def stream_affinity(deltas: DataFrame, log: AppendTable, hours: AppendTable, checkpoint: str) -> StreamingQuery:
    """Append each batch to the log and its touched hours to `hours`; a replayed batch replaces its own rows."""

    def handle(batch: DataFrame, epoch: int) -> None:
        log.write(batch.select(*DELTA_COLUMNS), epoch)
        hours.write(touched_hours(batch, log.before(epoch)), epoch)

    return each_batch(deltas, checkpoint, handle)


def current_affinity(hours: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Affinities from the rows of `hours`. The updates of an hour only grow, so its version with most is the last."""
    keys = _keys(by)
    latest = hours.groupBy(*keys, "_bucket").agg(F.max_by(F.struct("n", "part", "first_delta", "last"), "n").alias("h"))
    return chain_hours(latest.select(*keys, "_bucket", "h.*"), keys)
