"""Shared helpers: written tables, row decisions, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.session import shared_folder

# Bounds of the batches that tasks hand to Python: rows and bytes, whichever comes first.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a task's memory does not depend on the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not used before, in the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: lineage is cut and lost tasks reread it."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def batches(rows: Iterator[pa.RecordBatch], schema: pa.Schema, make) -> Iterator[pa.RecordBatch]:
    """`make(batch)` gives a column dict per input batch; empty ones are left out."""
    for batch in rows:
        columns = make(batch)
        if columns is not None and len(next(iter(columns.values()))):
            yield pa.RecordBatch.from_pydict(columns, schema=schema)


def keep_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id", once: str | None = None) -> DataFrame:
    """Rows of `docs` whose key is among `ids`, and those without key, with all their columns.

    With `once`, the name of a text column, one row of those that repeat key and text; the
    shuffle of the join serves for that as well.
    """
    wanted = ids.filter(F.col(key).isNotNull()).select(key).distinct()
    rows = docs.filter(F.col(key).isNotNull()).join(wanted.hint("merge"), key, "left_semi")
    if once:
        order = W.partitionBy(key, F.xxhash64(text_of(once))).orderBy(F.lit(1))
        rows = rows.withColumn("_repeat", F.row_number().over(order)).filter("_repeat = 1").drop("_repeat")
    return rows.select(*docs.columns).union(docs.filter(F.col(key).isNull()))


def components(links: DataFrame, a: str, b: str, name: str = "labels") -> DataFrame:
    """(node, label) for every node in `links`; the label is the smallest node reachable.

    Rounds of least label among the neighbours, each followed by a jump to the label's own
    label, so chains shorten by more than one link a round. Every round is written; neither
    links nor labels pass through the driver, only the count of changes does.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = written(one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = written(both.groupBy("u").agg(F.min("v").alias("m"))
                     .select(F.col("u").alias("node"), F.least("u", "m").alias("label")), name)
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        better = labels.join(near, F.col("node") == F.col("u")).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        after = written(better.join(jump, F.col("label") == F.col("_n")).select(
            "node", "old", F.least("label", "_l").alias("label")), name)
        changed = not after.filter("label <> old").isEmpty()
        labels = after.select("node", "label")
        if not changed:
            return labels
