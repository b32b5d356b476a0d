"""Payload, feed and page parsing on small bodies; crawl trimming; presets; dedup levels."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from newsloom.operators import dedup
from newsloom.sources import catalog, crawl_log, feed, html_pages, json_payload, tables


def payload(spark, *bodies):
    rows = [(i, b if isinstance(b, str) else json.dumps(b), "https://e.com/list") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "id int, body string, base_url string")


def test_json_paths(spark):
    rec = [{"title": " A ", "url": "/a"}, {"title": "", "url": "/b"}, "junk", {"title": "C"}, {"title": "D", "url": "https://o.org/d"}]
    bodies = payload(spark, {"data": {"list": rec}}, rec, {"title": "Solo", "url": "/solo"}, "not json", "5", {"data": {"list": 3}})
    got = json_payload.json_items(bodies, "data.list").orderBy("id", "url").collect()
    assert [(r["id"], r["title"], r["url"]) for r in got] == [
        (0, "A", "https://e.com/a"), (0, "D", "https://o.org/d"),
        (1, "A", "https://e.com/a"), (1, "D", "https://o.org/d"), (2, "Solo", "https://e.com/solo")]
    assert got[0]["raw_count"] == 5


def test_json_numeric_key_prefix_and_limits(spark):
    bodies = payload(spark, {"pages": [[], [{"n": "x" * 600, "id": 7, "d": "y" * 900}]]})
    row = json_payload.json_items(bodies, "pages.1", "n", "PREF:https://h.org/|id", "d").first()
    assert len(row["title"]) == 500 and row["url"] == "https://h.org/7" and len(row["summary"]) == 400


def test_json_shape(spark):
    bodies = payload(spark, {"meta": {"x": 1}, "data": {"children": [{"Headline": "a", "permalink": "b", "Body": "c"}]}}, "{", [{"name": 1, "href": 2}])
    got = {r["id"]: r for r in json_payload.infer_shape(bodies, "id").collect()}
    assert (got[0]["list_path"], got[0]["title_field"], got[0]["link_field"], got[0]["summary_field"]) == ("data.children", "Headline", "permalink", "Body")
    assert (got[1]["list_path"], got[1]["title_field"]) == ("", "title")
    assert (got[2]["title_field"], got[2]["link_field"]) == ("name", "href")


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/x"><channel><title>t</title>
<item><title>One &amp; two</title><link>https://e.com/1</link><description>&lt;p&gt;Hello&lt;/p&gt;</description></item>
<item><title>Guid</title><guid isPermaLink="true">https://e.com/g</guid><content:encoded><![CDATA[<b>Body</b>]]></content:encoded></item>
<item><title>No link</title><guid>abc</guid></item><item><link>https://e.com/none</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>
<entry><title>A</title><link rel="self" href="https://e.com/self"/><link rel="alternate" href="https://e.com/a"/><summary>S</summary></entry>
<entry><title>B</title><link href="https://e.com/b"/><content>Long text</content></entry></feed>"""


def test_feeds(spark):
    bodies = spark.createDataFrame([("rss", RSS), ("atom", ATOM), ("bad", "<rss><channel><item>"), ("no", "hello")], "id string, body string")
    got = [(r["id"], r["title"], r["url"], r["summary"]) for r in feed.feed_items(bodies).orderBy("id", "url").collect()]
    assert got == [("atom", "A", "https://e.com/a", "S"), ("atom", "B", "https://e.com/b", "Long text"),
                   ("rss", "One & two", "https://e.com/1", "Hello"), ("rss", "Guid", "https://e.com/g", "Body")]


def test_feed_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "<x>\n</x>")], "feed_key string, xml string")
    feed.write_feeds(df, str(tmp_path / "f"))
    assert "".join(p.read_text() for p in (tmp_path / "f" / "feed_key=a").glob("part-*")).strip() == "<x>\n</x>"


PAGE = """<html><head><title>T &amp; x</title><meta name="description" content="D"></head><body><div class="list">
<div class="item big"><h2 class="t"><a href="/1">First</a></h2><div><p>sum 1</p></div></div>
<div class="item"><h2 class="t"><a href="2">Second</a></h2></div>
<div class="item"><h2 class="t">No link</h2></div></div><a class="next" href="?p=2">more</a></body></html>"""


def test_html_lists(spark):
    pages = spark.createDataFrame([(1, "https://e.com/en/", PAGE)], "page_id int, url string, html string")
    got = html_pages.linked_list_items(pages, "div", list_class="item").orderBy("position").collect()
    assert [(r["title"], r["link"], r["raw_count"]) for r in got] == [("First", "https://e.com/1", 3), ("Second", "https://e.com/en/2", 3)]
    assert html_pages.linked_list_items(pages, "div", list_class="ite").count() == 0
    p = html_pages.page_profile(pages).first()
    assert (p["kind"], p["title"], p["description"], p["list_selector"], p["links"]) == ("html", "T & x", "D", ".item", 3)


def test_crawl_trim(spark):
    rows = [("c", p, i, f"https://e.com/{min(p, 3)}-{i}", i != 1) for p in range(1, 6) for i in range(3)]
    log = spark.createDataFrame(rows, "crawl_id string, page_no int, item_no int, url string, kept boolean")
    assert crawl_log.trim_crawls(log).count() == 6
    assert crawl_log.trim_crawls(log, max_items=3).count() == 3
    assert crawl_log.trim_crawls(log, max_pages=1).count() == 2


def test_presets_and_gold(spark, tmp_path):
    path = tmp_path / "p.json"
    full = {k: "v" for k in catalog.PRESET_REQUIRED}
    path.write_text(json.dumps([{**full, "default_keywords": ["a"]}, {"id": "broken"}]))
    assert catalog.read_presets(spark, str(path)).count() == 1
    gold = tmp_path / "g.jsonl"
    gold.write_text('{"item_id": "a", "relevant": 1}\n\n{"item_id": "b", "relevant": false}\n')
    assert {(r[0], r[1]) for r in catalog.read_gold(spark, str(gold)).collect()} == {("a", True), ("b", False)}
    gold.write_text('{"relevant": 1}\n')
    with pytest.raises(Exception, match="without item_id"):
        catalog.read_gold(spark, str(gold)).collect()


def test_scan_and_quarantine(spark, tmp_path):
    spark.createDataFrame([(1, '["a"]', "success"), (2, "oops", "weird"), (3, None, None)], "id int, tags string, status string").write.parquet(str(tmp_path / "t"))
    df = tables.scan(spark, str(tmp_path / "t"), "id int, tags string, status string", {"tags": "array<string>"})
    assert {r["id"]: r["tags"] for r in df.collect()} == {1: ["a"], 2: [], 3: []}
    good, bad = tables.split_valid(df, "status", tables.EXECUTION_STATUSES)
    assert good.count() == 1 and bad.count() == 2


ITEM = "item_id int, task_id string, title string, summary string, url string, external_id string, created_at timestamp_ntz"


def items(spark, *rows):
    from datetime import datetime
    return spark.createDataFrame([(*r, datetime(2024, 1, 1, 0, r[0])) for r in rows], ITEM)


def test_dedup_levels(spark):
    history = dedup.with_keys(items(spark, (1, "a", "T", "S", "https://e.com/1", "x1")))
    batch = dedup.with_keys(items(
        spark, (2, "a", "new", "n", "https://e.com/2", "x1"), (3, "b", "new", "o", "https://e.com/3", "x1"),
        (4, "a", "new", "p", "https://E.com/1#f", None), (5, "a", " T ", "S", "https://e.com/5", ""),
        (6, "", "new", "q", "https://e.com/6", "x1"), (7, "a", "new", "r", "https://e.com/7", None)))
    assert {r[0] for r in dedup.drop_known(batch, history).select("item_id").collect()} == {3, 7}


def test_unique_in_batch(spark):
    batch = dedup.with_keys(items(
        spark, (1, "a", "T", "S", "https://e.com/1", "k"), (2, "a", "U", "S", "https://e.com/1/", "m"),
        (3, "a", "V", "S", "https://e.com/3", "k"), (4, "b", "T", "S", "https://e.com/4", "k"), (5, "a", "T", "S", "https://e.com/5", None)))
    assert {r[0] for r in dedup.unique_in_batch(batch).select("item_id").collect()} == {1, 4, 5}


def test_a_failed_row_takes_no_key(spark):
    batch = dedup.with_keys(items(
        spark, (1, "a", "T", "S", "https://e.com/1", "k"), (2, "a", "U", "S", "https://e.com/2", "k"),
        (3, "a", "V", "S", "https://e.com/2", "m"), (4, "a", "W", "S", "https://e.com/3", "m"), (5, "a", "W", "S", "https://e.com/3", None)))
    assert {r[0] for r in dedup.unique_in_batch(batch).select("item_id").collect()} == {1, 3, 5}
    assert dedup.unique_in_batch(batch.limit(0)).count() == 0


def test_blank_keys_spread(spark):
    many = spark.range(2000).select(
        F.col("id").cast("int").alias("item_id"), F.lit("a").alias("task_id"), F.lit("t").alias("title"), F.col("id").cast("string").alias("summary"),
        F.concat(F.lit("https://e.com/"), F.col("id").cast("string")).alias("url"), F.lit(None).cast("string").alias("external_id"),
        F.current_timestamp().cast("timestamp_ntz").alias("created_at"))
    keyed = dedup.with_keys(many)
    assert dedup.drop_known(keyed, keyed.filter("item_id < 500")).count() == 1500
