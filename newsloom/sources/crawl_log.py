"""Trim a multi-page crawl log: stop at a repeated page, at a page limit, at an item limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.urls import url_hash


def trim_crawls(log: DataFrame, max_pages: int | None = None, max_items: int | None = None) -> DataFrame:
    """Kept items of each crawl with their order; without limits only a repeated page ends a crawl.

    `log`: crawl_id, page_no (from 1), item_no, url, kept (passed the keyword filter).
    A page whose set of URL hashes equals the previous page's ends the crawl; the comparison
    uses all items, the item limit counts the kept ones. Every window holds the pages of one
    crawl or the items of one page.
    """
    if max_pages is not None:
        log = log.filter(F.col("page_no") <= max_pages)
    log = log.withColumn("url_hash", url_hash(F.col("url")))
    pages = log.groupBy("crawl_id", "page_no").agg(
        F.sort_array(F.collect_set("url_hash")).alias("hashes"),
        F.count_if("kept").alias("n_kept"))
    by_page = W.partitionBy("crawl_id").orderBy("page_no")
    repeated = F.coalesce(F.lag("hashes").over(by_page) == F.col("hashes"), F.lit(False))
    pages = pages.withColumn("repeated", repeated.cast("int"))
    upto, before = by_page.rowsBetween(W.unboundedPreceding, 0), by_page.rowsBetween(W.unboundedPreceding, -1)
    pages = pages.select(
        "crawl_id", "page_no", F.max("repeated").over(upto).alias("stopped"),
        F.coalesce(F.sum("n_kept").over(before), F.lit(0)).alias("items_before"))
    alive = pages.filter(F.col("stopped") == 0)
    if max_items is not None:
        alive = alive.filter(F.col("items_before") < max_items)
    in_page = W.partitionBy("crawl_id", "page_no").orderBy("item_no")
    items = log.filter("kept").join(alive, ["crawl_id", "page_no"])
    ranked = items.withColumn("item_order", F.col("items_before") + F.row_number().over(in_page))
    if max_items is not None:
        ranked = ranked.filter(F.col("item_order") <= max_items)
    return ranked.drop("stopped", "items_before", "kept")
