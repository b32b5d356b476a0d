"""Parser mode of a source, told by the prefix of its selector, and items by mode."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import strip
from newsloom.sources.feed import feed_items
from newsloom.sources.html_pages import linked_list_items
from newsloom.sources.json_payload import json_items

# Selector prefixes, longest first, and what parts a list path from a request body.
PREFIXES = ("json-post", "json", "rss")
BODY_MARK = "|||"


def source_mode(selector: Column) -> Column:
    """(mode, path, post_body) of a selector: `json-post:path|||{body}`, `json:path`, `rss:`, else HTML.

    The path of HTML is the selector itself; a request body that is no JSON object is `{}`.
    """
    text = F.coalesce(selector, F.lit(""))
    mode = reduce(lambda otherwise, m: F.when(text.startswith(f"{m}:"), F.lit(m)).otherwise(otherwise),
                  reversed(PREFIXES), F.lit("html"))
    rest = F.when(mode == "html", text).otherwise(text.substr(F.length(mode) + 2, F.length(text)))
    path = F.when(mode == "html", text).when(mode == "rss", "").otherwise(
        strip(F.when(mode == "json-post", F.substring_index(rest, BODY_MARK, 1)).otherwise(rest)))
    body = rest.substr(F.locate(BODY_MARK, rest) + len(BODY_MARK), F.length(rest))
    good = rest.contains(BODY_MARK) & F.try_variant_get(F.try_parse_json(body), "$", "map<string,variant>").isNotNull()
    return F.struct(mode.alias("mode"), path.alias("path"),
                    F.when(mode == "json-post", F.when(good, body).otherwise("{}")).alias("post_body"))


def items_by_mode(payloads: DataFrame, paths: Mapping[str, tuple[str, ...]], selector: str = "selector", body: str = "body",
                  base_url: str = "base_url") -> DataFrame:
    """(source columns, mode, title, url) of payloads read by each one's own mode.

    `paths` names the list paths that occur per JSON mode: sources share few layouts, and a path
    is part of the plan. Payloads of other paths give no row.
    """
    kept = [c for c in payloads.columns if c not in (selector, body, base_url)]
    rows = payloads.withColumn("_m", source_mode(F.col(selector)))

    def of(mode: str, path: str | None = None) -> DataFrame:
        own = rows.filter(F.col("_m.mode") == mode)
        return (own if path is None else own.filter(F.col("_m.path") == path)).drop("_m", selector)

    parts = [json_items(of(mode, path), path, body=body, base_url=base_url).select(*kept, F.lit(mode).alias("mode"), "title", "url")
             for mode in ("json", "json-post") for path in paths.get(mode, ())]
    parts.append(feed_items(of("rss"), body).select(*kept, F.lit("rss").alias("mode"), "title", "url"))
    parts.append(linked_list_items(of("html"), html=body, url=base_url).select(
        *kept, F.lit("html").alias("mode"), "title", F.col("link").alias("url")))
    return reduce(DataFrame.unionByName, parts)
