"""Item deduplication: against history, inside a batch, and the accounting of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.text import strip
from newsloom.functions.urls import url_hash
from newsloom.session import cut_lineage


def content_hash(title: Column, summary: Column) -> Column:
    """SHA-256 of the stripped title and summary."""
    text = F.concat(strip(F.coalesce(title, F.lit(""))), F.lit("|"), strip(F.coalesce(summary, F.lit(""))))
    return F.sha2(text, 256)


def with_keys(items: DataFrame) -> DataFrame:
    """Add url_hash and content_hash."""
    return items.withColumns({
        "url_hash": url_hash(F.col("url")),
        "content_hash": content_hash(F.col("title"), F.col("summary")),
    })


def _usable(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def item_keys(items: DataFrame, probing: bool = False) -> DataFrame:
    """(item_id, kind, key): what an item is known by, without its texts. A blank key makes no row.

    Kinds: `task` (task and external id together), `any` (external id in whatever task), `url` and
    `content`. With `probing`, `any` is left to items without a task, which compare with every task.
    """
    task, external = F.col("task_id").cast("string"), F.col("external_id").cast("string")
    with_task, with_id = _usable("task_id"), _usable("external_id")
    # The length in front tells where the task ends.
    pair = F.concat(F.length(task).cast("string"), F.lit(":"), task, external)
    keys = {
        "task": F.when(with_task & with_id, pair),
        "any": F.when(with_id & ~with_task if probing else with_id, external),
        "url": F.when(_usable("url_hash"), F.col("url_hash")),
        "content": F.when(_usable("content_hash"), F.col("content_hash")),
    }
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in keys.items()])
    return items.select("item_id", F.inline(rows)).filter(F.col("key").isNotNull())


def drop_matched(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Batch rows none of whose keys is in `known` (kind, key). `item_id` names a row of the batch.

    Only keys meet, in one semi-join; a key that history holds often is one row there. Rows that
    match by one key or several are then left out by id.
    """
    met = item_keys(batch, probing=True).join(known.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
    return batch.join(met.select("item_id").distinct(), "item_id", "left_anti").select(*batch.columns)


def drop_known(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Batch rows new to history by external id (same task), URL hash and content hash.

    A row without a task compares its external id with every task.
    """
    return drop_matched(batch, item_keys(history))


def unique_in_batch(batch: DataFrame) -> DataFrame:
    """Rows that row-by-row insertion would keep, by arrival (created_at, item_id).

    A row is kept if no kept row before it has its URL hash or its (task, external id); blank
    hashes and ids are unique, equal content is kept. A row that fails takes neither of its keys,
    so rows are settled in rounds: those that come first in both their groups are kept, those
    that share a key with a kept one go, the rest is looked at again. Only keys take part; a hot
    key sends one row per task.
    """
    blank = F.concat(F.lit("\u0000blank:"), F.col("item_id").cast("string"))
    known = batch.select(
        "item_id", F.struct("created_at", "item_id").alias("at"),
        F.when(_usable("url_hash"), F.col("url_hash")).otherwise(blank).alias("u"),
        F.concat_ws("\u0000", F.coalesce(F.col("task_id").cast("string"), F.lit("\u0000none")),
                    F.when(_usable("external_id"), F.col("external_id")).otherwise(blank)).alias("e"))
    open_rows, kept = cut_lineage(known), None
    while not open_rows.isEmpty():
        first_u = open_rows.groupBy("u").agg(F.min("at").alias("a")).select(F.col("a.item_id").alias("item_id"))
        first_e = open_rows.groupBy("e").agg(F.min("at").alias("a")).select(F.col("a.item_id").alias("item_id"))
        both = cut_lineage(open_rows.join(first_u.join(first_e, "item_id"), "item_id", "left_semi"))
        kept = both.select("item_id") if kept is None else kept.union(both.select("item_id"))
        open_rows = cut_lineage(open_rows.join(both.select("u"), "u", "left_anti").join(both.select("e"), "e", "left_anti"))
    return batch.limit(0) if kept is None else batch.join(kept, "item_id", "left_semi")


def dedup_accounting(batch: DataFrame, fresh: DataFrame, by: str = "task_id") -> DataFrame:
    """Per run: rows seen, new, duplicate."""
    new = fresh.groupBy(by).agg(F.count("*").alias("items_new"))
    seen = batch.groupBy(by).agg(F.count("*").alias("items_seen"))
    return seen.join(new, by, "left").select(
        by, "items_seen", F.coalesce("items_new", F.lit(0)).alias("items_new"),
        (F.col("items_seen") - F.coalesce("items_new", F.lit(0))).alias("items_duplicate"))


def first_per_topic(topics: DataFrame) -> DataFrame:
    """One row per topic, the earliest kept."""
    order = W.partitionBy("topic").orderBy("seq")
    return topics.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") == 1).drop("_rn")
