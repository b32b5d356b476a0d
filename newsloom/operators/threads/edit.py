"""Bulk merge and split of threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.threads.relations import canonical
from newsloom.operators.threads.rollup import roll_up
from newsloom.session import cut_lineage

UNKNOWN_SIMILARITY = 0.5


def resolve_merges(merges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Final target of every merged thread: (thread_id, target_id).

    `merges`: thread_id → target_id, one target per thread; self merges are refused (dropped).
    Each round jumps twice as far along the chain, so a chain of length n takes log2(n) rounds.
    """
    links = cut_lineage(merges.filter("thread_id <> target_id").groupBy("thread_id").agg(F.min("target_id").alias("target_id")))
    for _ in range(max_rounds):
        onward = links.select(F.col("thread_id").alias("target_id"), F.col("target_id").alias("_next"))
        jumped = cut_lineage(
            links.join(onward, "target_id", "left").select(
                "thread_id", F.coalesce("_next", "target_id").alias("target_id"), F.col("_next").isNotNull().alias("moved")))
        links = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return links
    raise ValueError("merges form a cycle")


def merge_threads(members: DataFrame, relations: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, relations) after merging. Moved items get similarity 1; an item already in the
    target keeps its row, of several moved ones the row of the smallest thread. Members keep their other
    columns. Redirected pairs keep the stronger similarity; self pairs vanish."""
    target = resolve_merges(merges)
    moves = F.col("target_id").isNotNull()
    others = [c for c in members.columns if c not in ("thread_id", "item_id", "similarity")]
    rows = members.join(target, "thread_id", "left").select(
        F.coalesce("target_id", "thread_id").alias("thread_id"), "item_id", F.struct(moves.alias("m"), F.col("thread_id").alias("t")).alias("moved"),
        F.struct(F.when(moves, 1.0).otherwise(F.col("similarity")).alias("similarity"), *others).alias("row"))
    kept = rows.groupBy("thread_id", "item_id").agg(F.min_by("row", "moved").alias("row")).select("thread_id", "item_id", "row.*")

    to_a = target.select(F.col("thread_id").alias("thread_a"), F.col("target_id").alias("_to_a"))
    to_b = target.select(F.col("thread_id").alias("thread_b"), F.col("target_id").alias("_to_b"))
    pairs = relations.join(to_a, "thread_a", "left").join(to_b, "thread_b", "left")
    pairs = pairs.select(
        F.coalesce("_to_a", "thread_a").alias("thread_a"), F.coalesce("_to_b", "thread_b").alias("thread_b"), "similarity",
        F.struct((F.col("_to_a").isNotNull() | F.col("_to_b").isNotNull()).alias("moved"),
                 F.col("thread_a").alias("a"), F.col("thread_b").alias("b")).alias("_order"), "source")
    merged = canonical(pairs).groupBy("thread_a", "thread_b").agg(
        F.max("similarity").alias("similarity"), F.min_by("source", "_order").alias("source"))
    return kept, merged


def split_threads(members: DataFrame, relations: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, relations, new thread titles) after moving items to new threads.

    `moves`: thread_id, item_id, new_thread_id, new_title (NULL: title of the first moved item).
    A split that would empty its thread is refused. The new pair's similarity is the mean
    similarity the moved items had. Members keep their other columns.
    """
    wanted = members.join(moves, ["thread_id", "item_id"]).select(
        "thread_id", "item_id", "new_thread_id", "new_title", "title", "similarity")
    sizes = members.groupBy("thread_id").agg(F.count("*").alias("n_all"))
    asked = wanted.groupBy("thread_id").agg(F.count("*").alias("n_moved"))
    allowed = sizes.join(asked, "thread_id").filter("n_moved < n_all").select("thread_id")
    moved = wanted.join(allowed, "thread_id", "left_semi")
    goes = moved.select("thread_id", "item_id", "new_thread_id").distinct()
    members_after = members.join(goes, ["thread_id", "item_id"], "left").withColumns({
        "similarity": F.when(F.col("new_thread_id").isNotNull(), 1.0).otherwise(F.col("similarity")),
        "thread_id": F.coalesce("new_thread_id", "thread_id")}).drop("new_thread_id")
    born = moved.groupBy("thread_id", "new_thread_id").agg(
        F.avg("similarity").alias("mean"), F.max("new_title").alias("given"), F.min_by("title", "item_id").alias("first"))
    links = canonical(born.select(
        F.col("thread_id").alias("thread_a"), F.col("new_thread_id").alias("thread_b"),
        F.coalesce("mean", F.lit(UNKNOWN_SIMILARITY)).alias("similarity"), F.lit("split").alias("source")))
    fresh = links.join(relations.select("thread_a", "thread_b"), ["thread_a", "thread_b"], "left_anti")
    titles = born.select(F.col("new_thread_id").alias("thread_id"), F.coalesce("given", "first").alias("title"))
    return members_after, relations.unionByName(fresh.select(*relations.columns)), titles


def rebuilt_threads(members: DataFrame, names: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """Thread rows of the members that a merge or a split left; threads without members are gone.

    `titles` (thread_id, title) are those of new threads, which they keep until they are rolled up again.
    """
    rows = roll_up(members, names)
    if titles is None:
        return rows
    given = titles.select("thread_id", F.col("title").alias("_given"))
    return rows.join(given, "thread_id", "left").withColumn("title", F.coalesce("_given", "title")).drop("_given").select(*rows.columns)
