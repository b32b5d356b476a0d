"""Running aggregates that never need a whole key in one task.

A key may hold a third of all rows, so `PARTITION BY key` windows are avoided for unbounded
groups. Rows are windowed inside (key, bucket), one summary row per bucket is accumulated over
the buckets of the key, and both parts are put together.

The bucket is normally the hour or day of the row. Where one (key, hour) is itself too large,
the rows are range-partitioned by key and order instead, which splits any group evenly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.session import cut_lineage

# Rows one window group may hold before the bucket is replaced by range partitions.
GROUP_ROWS = 2_000_000

_AGG = {"sum": F.sum, "max": F.max}


def by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with `_bucket` = number of their range partition by key and order.

    Written before use: every reader must see the same partition numbers.
    """
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_bucket", F.spark_partition_id()))


def bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """Rows with a `_bucket` that no group overfills. Counts groups first, so pass narrow, stored rows."""
    marked = df.withColumn("_bucket", bucket)
    sizes = marked.groupBy(*keys, "_bucket").agg(F.count("*").alias("n"))
    return marked if sizes.filter(F.col("n") > GROUP_ROWS).isEmpty() else by_range(df, keys, order)


def _join_same(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the summary of their group; a missing key or time is a value like any other."""
    named = summary.select(*[F.col(k).alias(f"_same_{k}") if k in keys else F.col(k) for k in summary.columns])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys])
    return rows.join(named, same).drop(*[f"_same_{k}" for k in keys])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    values: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add one running `sum` (NULL as 0) or `max` column per entry of `values`.

    `bucket` must not decrease along `order`. With `inclusive=False` the current row is left
    out. The bucket summaries are stored, as they also tell whether a bucket is overfull.
    """
    group = [*keys, "_bucket"]

    def summarise(rows: DataFrame) -> DataFrame:
        return cut_lineage(rows.groupBy(*group).agg(
            F.count("*").alias("_rows"), *[_AGG[kind](col).alias(name) for name, (kind, col) in values.items()]))

    marked = df.withColumn("_bucket", bucket)
    totals = summarise(marked)
    if not totals.filter(F.col("_rows") > GROUP_ROWS).isEmpty():
        marked = by_range(df, keys, order)
        totals = summarise(marked)
    inside = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*group, *[_AGG[kind](name).over(earlier).alias(f"_before_{name}")
                                     for name, (kind, _) in values.items()])
    local = marked.withColumns({name: _AGG[kind](col).over(inside) for name, (kind, col) in values.items()})
    joined = _join_same(local, before, group)
    combined = {
        name: (F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"_before_{name}"), F.lit(0))) if kind == "sum"
        else F.greatest(F.col(name), F.col(f"_before_{name}"))
        for name, (kind, _) in values.items()
    }
    return joined.withColumns(combined).drop("_bucket", *[f"_before_{n}" for n in values])


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                   value: str, name: str) -> DataFrame:
    """Add the value of the preceding row of the same key (NULL for the first)."""
    group = [*keys, "_bucket"]

    def summarise(rows: DataFrame) -> DataFrame:
        return cut_lineage(rows.groupBy(*group).agg(
            F.count("*").alias("_rows"), F.max_by(F.struct(value), F.struct(*order)).alias("_last")))

    marked = df.withColumn("_bucket", bucket)
    last = summarise(marked)
    if not last.filter(F.col("_rows") > GROUP_ROWS).isEmpty():
        marked = by_range(df, keys, order)
        last = summarise(marked)
    carried = last.select(*group, F.lag("_last").over(W.partitionBy(*keys).orderBy("_bucket")).alias("_carried"))
    local = marked.withColumn("_prev", F.lag(F.struct(value)).over(W.partitionBy(*group).orderBy(*order)))
    return _join_same(local, carried, group).withColumn(
        name, F.coalesce("_prev", "_carried")[value]).drop("_bucket", "_prev", "_carried")


def day(ts: str) -> Column:
    return F.to_date(ts)


def hour(ts: str) -> Column:
    return F.date_trunc("hour", ts)
