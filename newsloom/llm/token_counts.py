"""Token counts through a digest cache.

The cache is a table of (content digest, tokenizer-version digest, count). Documents join it on
both digests; each distinct content that misses is encoded once and appended. A later run, or a
run over more documents, encodes only what no run has seen with that tokenizer version.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import common
from newsloom.llm.tokens import encoder, file_digest

CACHE_SCHEMA = "content string, version string, n_tokens long"

MOST_FREQUENT = 1000


def version_digest(path: str) -> str:
    """Of the vocabulary file and of how it is used."""
    return hashlib.sha256(f"{file_digest(path)}|plain text, no added tokens around it".encode()).hexdigest()


def read_cache(spark, folder: str, version: str) -> DataFrame:
    """Counts of one tokenizer version; an empty table where the folder holds nothing yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(folder) if there else spark.createDataFrame([], CACHE_SCHEMA)
    # Runs at the same time may both append a content; its count is the same.
    return cache.filter(F.col("version") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(texts: DataFrame, path: str) -> DataFrame:
    """(content, n_tokens) of (content, t)."""
    schema = pa.schema([("content", pa.string()), ("n_tokens", pa.int64())])

    def make(batch: pa.RecordBatch) -> dict:
        return {"content": batch.column(0), "n_tokens": encoder(path).count_all(batch.column(1))}

    return texts.mapInArrow(lambda rows: common.batches(rows, schema, make), "content string, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str, cache: str, key: str = "doc_id", text: str = "text",
                 limit: int = 1024) -> DataFrame:
    """One row per row of `docs`: key, n_bytes, n_tokens, over_limit. Appends to the `cache` folder.

    The content is the whole text, a null one as empty (0 tokens); nothing else is normalised, as
    it would change counts. Equal texts share one count, whatever their keys; a null or repeated
    key is as good as any. Other columns are not read.
    """
    spark, version = docs.sparkSession, version_digest(tokenizer)
    content = common.text_of(text)
    rows = common.written(docs.select(F.col(key), F.octet_length(content).cast("long").alias("n_bytes"),
                                      F.sha2(content, 256).alias("content")), "contents")
    contents = common.written(rows.groupBy("content").agg(F.min(key).alias("_k"), F.count("*").alias("times")), "distinct")
    misses = contents.join(read_cache(spark, cache, version), "content", "left_anti").select("content", "_k")
    texts = docs.select(F.col(key).alias("_key"), content.alias("t"), F.sha2(content, 256).alias("content"))
    same = texts["content"] == misses["content"]
    chosen = texts.join(misses.hint("merge"), same & texts["_key"].eqNullSafe(misses["_k"]), "left_semi")
    fresh = encode_misses(chosen.select("content", "t"), tokenizer).dropDuplicates(["content"])
    fresh.select("content", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, version)
    # Contents of more than one row in MOST_FREQUENT: at most that many, so their counts go to all tasks
    # and their rows stay where they are.
    total = contents.agg(F.sum("times")).first()[0] or 0
    frequent = contents.filter(F.col("times") * MOST_FREQUENT > total).select("content")
    held = F.broadcast(frequent.join(counts, "content").withColumnRenamed("n_tokens", "_frequent"))
    marked = rows.join(held, "content", "left")
    columns = [F.col(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")]
    return (marked.filter("_frequent IS NOT NULL").withColumnRenamed("_frequent", "n_tokens").select(*columns)
            .unionByName(marked.filter("_frequent IS NULL").join(counts, "content").select(*columns)))
