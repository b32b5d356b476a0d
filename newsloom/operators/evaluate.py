"""Ranking evaluation: precision, recall, NDCG, pairwise win rate, and the report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import windows

# Cut-offs of the report.
CUTOFFS = (5, 10, 20)
SCORE_BUCKETS = 1000


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """Per list and k: precision (k capped at the list length), recall and binary NDCG.

    `ranked`: list_id, item_id, rank from 1. `relevant`: list_id, item_id. Hits are aggregated
    per list without a window; the ideal gain is a closed sum over 1…min(k, relevant).
    """
    if any(k <= 0 for k in cutoffs):
        raise ValueError("k must be positive")
    truth = relevant.select("list_id", "item_id").distinct().withColumn("_rel", F.lit(1))
    judged = ranked.join(truth, ["list_id", "item_id"], "left")
    hit = F.col("_rel").isNotNull()
    aggs = [F.count("*").alias("n")]
    for k in cutoffs:
        top = hit & (F.col("rank") <= k)
        aggs += [F.count_if(top).alias(f"hits_{k}"),
                 F.sum(F.when(top, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"gain_{k}")]
    per_list = judged.groupBy("list_id").agg(*aggs)
    sizes = truth.groupBy("list_id").agg(F.count("*").alias("n_relevant"))
    rows = per_list.join(sizes, "list_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))

    def ideal(k: int) -> Column:
        top = F.least(F.lit(k), F.col("n_relevant"))
        return F.when(top > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(top, F.lit(1)).cast("int")), F.lit(0.0),
                                           lambda acc, i: acc + 1 / F.log2(i + 1)))

    by_k = F.array(*[F.struct(
        F.lit(k).alias("k"),
        F.coalesce(F.try_divide(F.col(f"hits_{k}"), F.least(F.lit(k), F.col("n"))), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(F.col(f"hits_{k}"), F.col("n_relevant")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(F.col(f"gain_{k}"), ideal(k)), F.lit(0.0)).alias("ndcg")) for k in cutoffs])
    return rows.select("list_id", F.explode(by_k).alias("m")).select("list_id", "m.*")


def win_rate(scores: DataFrame, buckets: int = SCORE_BUCKETS) -> DataFrame:
    """Share of (positive, negative) pairs where the positive scores higher; a tie counts half.

    `scores`: label 0/1, score in [0, 1]. Pairs are counted, not built: per distinct score the
    negatives below come from a running count. NULL when either side is empty.
    """
    known = scores.filter(F.col("score").isNotNull())
    per_score = known.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).withColumn("_all", F.lit(1))
    rows = windows.running(per_score, ["_all"], ["score"], F.floor(F.col("score") * buckets),
                           {"below": ("sum", F.col("neg"))}, inclusive=False)
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") * 0.5))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return rows.agg(F.try_divide(wins, pairs).alias("win_rate"))


def label_summary(labels: DataFrame) -> DataFrame:
    """Labels by sign and the win rate of their score snapshots, one row."""
    rate = win_rate(labels.select("label", F.col("sampled_score").alias("score"))).scalar()
    return labels.agg(
        F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("positive"),
        F.count_if(F.col("label") == 0).alias("negative")).withColumn("win_rate", F.round(rate, 4))


def relevant_items(gold: DataFrame | None, items: DataFrame) -> DataFrame:
    """Items counted as relevant: gold labels when given, else starred items."""
    if gold is not None:
        return gold.filter("relevant").select("item_id")
    return items.filter("is_starred").select("item_id")


def report(ranked: DataFrame, relevant: DataFrame, irrelevant: DataFrame, limit: int = 20) -> DataFrame:
    """(metric, k, value): ranking metrics, labelled misses in the top ten, relevant items not ranked."""
    cutoffs = [k for k in CUTOFFS if k <= limit] or [limit]
    truth = relevant.select("list_id", "item_id").distinct()
    metrics = ranking_metrics(ranked, truth, cutoffs)
    long = metrics.select("list_id", "k", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("precision", "recall", "ndcg")])).alias("v")) \
        .select("list_id", "v.metric", "k", "v.value")
    wrong = ranked.filter(F.col("rank") <= 10).join(irrelevant, ["list_id", "item_id"], "left_semi") \
        .groupBy("list_id").agg(F.count("*").cast("double").alias("value"))
    missed = truth.join(ranked, ["list_id", "item_id"], "left_anti").groupBy("list_id").agg(F.count("*").cast("double").alias("value"))
    lists = ranked.select("list_id").distinct()

    def row(name: str, k: int, counted: DataFrame) -> DataFrame:
        return lists.join(counted, "list_id", "left").select(
            "list_id", F.lit(name).alias("metric"), F.lit(k).alias("k"), F.coalesce("value", F.lit(0.0)).alias("value"))

    return long.unionByName(row("not_relevant_in_top", 10, wrong)).unionByName(row("missed_relevant", limit, missed))
