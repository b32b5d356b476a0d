"""Scan tables with a fixed schema; JSON text columns become typed columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM_SCHEMA = (
    "item_id string, task_id string, title string, url string, url_hash string, summary string, "
    "external_id string, content_hash string, is_read boolean, is_starred boolean, "
    "fetched_at timestamp, created_at timestamp"
)
EXECUTION_SCHEMA = (
    "execution_id string, task_id string, status string, items_fetched bigint, items_new bigint, "
    "duration_ms bigint, error_message string, executed_at timestamp"
)
RUN_EVENT_SCHEMA = (
    "event_id bigint, execution_id string, task_id string, state string, props string, created_at timestamp"
)

# The states and kinds a row may carry.
EXECUTION_STATUSES = ("running", "success", "warning", "failure", "interrupted")
TASK_STATUSES = ("active", "paused", "error")
INTERACTION_TYPES = (
    "view", "click", "dwell", "star", "share", "impression", "open", "click_source", "unstar",
    "read", "hide", "thread_expand", "search", "not_interested",
)
AFFINITY_TYPES = ("task", "platform", "keyword")
OVERRIDE_TYPES = ("split", "merge", "reject_merge", "force_join")
FEEDBACK_TYPES = ("not_interested", "hide_source", "mute_topic")
RECEIPT_STATUSES = ("pending", "done", "failed")


def decode_json(text: Column, schema: str) -> Column:
    """Typed value of a JSON text column; bad or missing JSON gives an empty collection."""
    empty = F.from_json(F.lit("[]" if schema.lower().startswith("array") else "{}"), schema)
    return F.coalesce(F.from_json(text, schema, {"mode": "PERMISSIVE"}), empty)


def scan(spark: SparkSession, path: str, schema: str, json_columns: Mapping[str, str] | None = None,
         fmt: str = "parquet") -> DataFrame:
    """Read one table. Only the columns a query selects are read, as the schema is declared."""
    df = spark.read.format(fmt).schema(schema).load(path)
    return decode_columns(df, json_columns or {})


def decode_columns(df: DataFrame, json_columns: Mapping[str, str]) -> DataFrame:
    return df.withColumns({name: decode_json(F.col(name), schema) for name, schema in json_columns.items()})


def split_valid(df: DataFrame, column: str, allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows) by an allowed set; NULL is quarantined."""
    ok = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return df.filter(ok), df.filter(~ok)
