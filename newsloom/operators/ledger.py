"""Model-call ledger: reuse, daily budget, usage and breaker audit over receipt tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import windows
from newsloom.functions.times import moment

# Fixed values.
DAILY_BUDGET, BREAKER_FAILURES = 200_000, 5


def prompt_hash(model: Column, system: Column, prompt: Column) -> Column:
    """SHA-256 of model, system text and prompt, separated by NUL."""
    return F.sha2(F.concat_ws("\u0000", model, F.coalesce(system, F.lit("")), prompt), 256)


def split_reusable(prompts: DataFrame, receipts: DataFrame) -> DataFrame:
    """Prompts with the newest finished result of the same model and hash; NULL means: call."""
    done = receipts.filter(F.col("status") == "done").groupBy("model", "prompt_hash").agg(
        F.max_by("result_text", F.struct("created_at", "receipt_id")).alias("reused_text"))
    return prompts.join(done, ["model", "prompt_hash"], "left").withColumn("to_call", F.col("reused_text").isNull())


def budget_left(receipts: DataFrame, as_of: str | datetime, budget: int = DAILY_BUDGET) -> DataFrame:
    """Tokens used since the start of the clock's day and what is left."""
    today = receipts.filter(F.to_date("created_at") == F.to_date(moment(as_of)))
    used = F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0))
    return today.agg(used.alias("used_tokens"), F.greatest(F.lit(0), F.lit(budget) - used).alias("remaining_tokens"))


def daily_usage(receipts: DataFrame) -> DataFrame:
    """Calls, results, failures and tokens per day."""
    return receipts.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def recent_receipts(receipts: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    total = receipts.agg(F.count("*").alias("n")).scalar()
    return receipts.orderBy(F.col("created_at").desc(), F.col("receipt_id").desc()) \
        .offset((page - 1) * per_page).limit(per_page).withColumn("total", total)


def audit(receipts: DataFrame, budget: int = DAILY_BUDGET, max_failures: int = BREAKER_FAILURES) -> DataFrame:
    """Per call: tokens used earlier that day, failures in a row before it, and whether the
    budget and the breaker would have let it through."""
    failed = F.col("status") == "failed"
    order = ["created_at", "receipt_id"]
    tokens = F.col("input_tokens") + F.col("output_tokens")
    rows = receipts.withColumn("_day", F.to_date("created_at"))
    rows = windows.running(rows, ["_day"], order, windows.hour("created_at"), {"used_before": ("sum", tokens)}, inclusive=False)
    rows = windows.running(rows, ["model"], order, windows.hour("created_at"), {"_fails": ("sum", failed.cast("int"))})
    # Failures counted at the latest success; the difference is the streak. Both never decrease.
    at_success = F.when(~failed, F.col("_fails"))
    rows = windows.running(rows, ["model"], order, windows.hour("created_at"), {"_base": ("max", at_success)}, inclusive=False)
    streak = F.col("_fails") - failed.cast("int") - F.coalesce("_base", F.lit(0))
    return rows.select(
        *receipts.columns, "used_before", streak.alias("failures_before"),
        (F.col("used_before") < budget).alias("within_budget"), (streak >= max_failures).alias("breaker_open"))
