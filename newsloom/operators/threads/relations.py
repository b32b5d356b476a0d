"""Storyline relations: undirected thread pairs, canonical as thread_a < thread_b."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(pairs: DataFrame, a: str = "thread_a", b: str = "thread_b") -> DataFrame:
    """Order each pair, drop self pairs."""
    ends = pairs.withColumn("_lo", F.least(a, b)).withColumn("_hi", F.greatest(a, b)).drop(a, b)
    return ends.withColumnsRenamed({"_lo": "thread_a", "_hi": "thread_b"}).filter("thread_a <> thread_b")


def record_relations(log: DataFrame, overrides: DataFrame, order: str = "seq") -> DataFrame:
    """First record per pair; automatic pairs the user rejected (either direction) are left out.

    `log`: thread_a, thread_b, similarity, source, and an arrival order. Split pairs are exempt
    from rejection.
    """
    pairs = canonical(log)
    rejected = canonical(
        overrides.filter(F.col("override_type") == "reject_merge")
        .select(F.col("thread_id").alias("thread_a"), F.col("target_thread_id").alias("thread_b")))
    auto = pairs.filter(F.col("source") != "split").join(rejected, ["thread_a", "thread_b"], "left_anti")
    kept = auto.unionByName(pairs.filter(F.col("source") == "split"))
    first = kept.groupBy("thread_a", "thread_b").agg(F.min_by(F.struct("similarity", "source"), order).alias("r"))
    return first.select("thread_a", "thread_b", "r.similarity", "r.source")


def both_directions(relations: DataFrame) -> DataFrame:
    """thread_id, other_id, similarity, source: each pair seen from both ends, from one scan."""
    ends = F.array(
        F.struct(F.col("thread_a").alias("thread_id"), F.col("thread_b").alias("other_id")),
        F.struct(F.col("thread_b").alias("thread_id"), F.col("thread_a").alias("other_id")))
    return relations.select(F.explode(ends).alias("e"), "similarity", "source") \
        .select("e.thread_id", "e.other_id", "similarity", "source")


def related_threads(relations: DataFrame, titles: DataFrame, thread_id: str | None = None) -> DataFrame:
    """Related threads with title, strongest first; one thread or all."""
    rows = both_directions(relations)
    if thread_id is not None:
        rows = rows.filter(F.col("thread_id") == thread_id)
    other = titles.select(F.col("thread_id").alias("other_id"), F.col("title").alias("other_title"))
    return rows.join(other, "other_id").select("thread_id", "other_id", "other_title", "similarity", "source") \
        .orderBy("thread_id", F.col("similarity").desc(), "other_id")


def relation_summary(relations: DataFrame, titles: DataFrame) -> DataFrame:
    """Per thread: number of relations and the strongest other thread (ties: smallest id)."""
    strongest = F.min_by("other_id", F.struct((-F.col("similarity")).alias("s"), F.col("other_id")))
    summed = both_directions(relations).groupBy("thread_id").agg(
        F.count("*").alias("related_count"), strongest.alias("related_top"), F.max("similarity").alias("related_similarity"))
    other = titles.select(F.col("thread_id").alias("related_top"), F.col("title").alias("related_title"))
    return summed.join(other, "related_top", "left")


def unlink(relations: DataFrame, overrides: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove pairs and append a reject record for each: (relations, overrides)."""
    gone = canonical(pairs.select("thread_a", "thread_b")).dropDuplicates()
    noted = gone.select(F.col("thread_a").alias("thread_id"), F.col("thread_b").alias("target_thread_id"),
                        F.lit("reject_merge").alias("override_type"))
    return relations.join(gone, ["thread_a", "thread_b"], "left_anti"), \
        overrides.select("thread_id", "target_thread_id", "override_type").unionByName(noted)


def override_audit(overrides: DataFrame, thread_id: str | None = None, limit: int = 50, order: str = "created_at") -> DataFrame:
    """Overrides touching a thread (either end), or the most recent ones."""
    if thread_id is not None:
        overrides = overrides.filter((F.col("thread_id") == thread_id) | (F.col("target_thread_id") == thread_id))
    return overrides.orderBy(F.col(order).desc(), "thread_id", "target_thread_id").limit(limit)
