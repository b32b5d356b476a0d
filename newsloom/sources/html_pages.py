"""HTML page tables → list items, and a profile of unknown pages, by patterns over the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import strip
from newsloom.functions.urls import resolve_url

TITLE_CHARS = 500
# List selectors tried in this order, and how many hits make a list.
LIST_SELECTORS = ("article", ".post", ".entry", ".item", ".list-item", ".card", "li.article",
                  "div.post", ".news-item", ".story")
LIST_MIN = 3


def unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def linked_list_items(pages: DataFrame, list_tag: str = "li", html: str = "html", url: str = "url",
                      list_class: str | None = None) -> DataFrame:
    """Items of lists whose element opens with its link: `<li><a href=…>text</a>`.

    With `list_class`, only elements with that class. Headings may stand between the element and its link.
    """
    named = "" if list_class is None else rf'\sclass="(?:[^"]*\s)?{list_class}(?:\s[^"]*)?"'
    pattern = rf'(?is)<{list_tag}\b[^>]*?{named}[^>]*>\s*(?:<h[1-6][^>]*>\s*)?<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    pair = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"),
        F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("text"))
    keep = [c for c in pages.columns if c != html]
    rows = pages.select(
        *keep, F.regexp_count(html, F.lit(rf"(?i)<{list_tag}\b[^>]*?{named}[^>]*>")).alias("raw_count"), F.posexplode(pair).alias("position", "m"))
    out = rows.select(
        *keep, "raw_count", "position",
        F.substring(strip(unescape(F.regexp_replace("m.text", "<[^>]+>", ""))), 1, TITLE_CHARS).alias("title"),
        F.when(F.col("m.href") != "", resolve_url(F.col(url), unescape(F.col("m.href")))).alias("link"))
    return out.filter((F.col("title") != "") & F.col("link").isNotNull())


def body_kind(body: Column) -> Column:
    """rss, json or html, from the text alone."""
    return (
        F.when(body.rlike(r"(?i)<(rss|feed|channel)\b"), "rss")
        .when(strip(body).rlike(r"^[{\[]"), "json")
        .otherwise("html")
    )


def _hits(html: Column, selector: str) -> Column:
    tag, _, css = selector.partition(".")
    tag = tag or "[a-zA-Z][a-zA-Z0-9]*"
    if not css:
        return F.regexp_count(html, F.lit(rf"(?i)<{tag}\b"))
    return F.regexp_count(html, F.lit(rf'(?i)<{tag}\s(?:[^>]*\s)?class="(?:[^"]*\s)?{css}(?:\s[^"]*)?"'))


def page_profile(pages: DataFrame, html: str = "html") -> DataFrame:
    """Kind, title, description, hits per list selector, and the first selector with enough hits."""
    body = F.col(html)
    counts = F.array(*[F.struct(F.lit(s).alias("selector"), _hits(body, s).alias("hits")) for s in LIST_SELECTORS])
    rows = pages.withColumn("selector_hits", counts)
    first = F.get(F.filter("selector_hits", lambda c: c["hits"] >= LIST_MIN), F.lit(0))["selector"]
    return rows.select(
        *[c for c in pages.columns if c != html],
        body_kind(body).alias("kind"),
        strip(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))).alias("title"),
        unescape(F.regexp_extract(html, r'(?is)<meta\s+name="description"\s+content="([^"]*)"', 1)).alias("description"),
        F.transform("selector_hits", lambda c: c["hits"]).alias("hits"),
        F.coalesce(first, F.lit("")).alias("list_selector"),
        F.regexp_count(body, F.lit(r"(?i)<a\s[^>]*href=")).alias("links"),
    )
