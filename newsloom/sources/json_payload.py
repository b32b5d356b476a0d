"""JSON payload tables → items, and the shape of unknown payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import let, strip
from newsloom.functions.urls import link_path, prefixed_link

# Length limits of parsed fields.
TITLE_CHARS, SUMMARY_CHARS = 500, 400
# Field names tried in this order, compared in lower case.
TITLE_FIELDS = ("title", "name", "headline", "subject", "question")
LINK_FIELDS = ("url", "link", "permalink", "href", "short_link_v2", "short_url")
SUMMARY_FIELDS = ("summary", "description", "desc", "content", "brief_content", "selftext", "body")


def _json_paths(dotted: str) -> list[str]:
    """Variant paths of a dotted path; a numeric key may index a list or name a field."""
    paths = ["$"]
    for key in [k for k in dotted.split(".") if k]:
        quoted = key.replace("\\", "\\\\").replace("'", "\\'")
        tails = [f"['{quoted}']"] + ([f"[{int(key)}]"] if key.isdigit() else [])
        paths = [p + t for p in paths for t in tails]
    return paths


def nested(node: Column, dotted: str, as_type: str = "variant") -> Column:
    """Value at a dotted path, or NULL. An empty path or `$` is the node itself."""
    if dotted in ("", "$"):
        return node if as_type == "variant" else F.try_variant_get(node, "$", as_type)
    return F.coalesce(*[F.try_variant_get(node, p, as_type) for p in _json_paths(dotted)])


def json_items(
    payloads: DataFrame,
    list_path: str = "",
    title: str = "title",
    link: str = "url",
    summary: str | None = None,
    body: str = "body",
    base_url: str = "base_url",
) -> DataFrame:
    """One row per usable element of each payload.

    The list sits at `list_path`; a missing path means the whole document, an object counts
    as a one-element list, anything else gives no row. Unreadable bodies give no row.
    """
    doc = F.try_parse_json(F.col(body))
    rows = payloads.withColumn("_doc", doc)
    at_path = nested(F.col("_doc"), list_path)
    found = F.when(at_path.isNull() | F.is_variant_null(at_path), F.col("_doc")).otherwise(at_path)
    rows = rows.withColumn("_node", found)
    as_list = F.try_variant_get(F.col("_node"), "$", "array<variant>")
    as_object = F.try_variant_get(F.col("_node"), "$", "map<string,variant>")
    rows = rows.withColumn("_list", F.coalesce(as_list, F.when(as_object.isNotNull(), F.array("_node"))))
    rows = rows.withColumn("raw_count", F.coalesce(F.size("_list"), F.lit(0)))
    item = F.col("_item")
    made = rows.select("*", F.explode("_list").alias("_item")).filter(
        F.try_variant_get(item, "$", "map<string,variant>").isNotNull())
    made = made.select(
        *payloads.columns, "raw_count",
        F.substring(strip(nested(item, title, "string")), 1, TITLE_CHARS).alias("title"),
        prefixed_link(link, nested(item, link_path(link), "string"), F.col(base_url)).alias("url"),
        (F.substring(strip(F.coalesce(nested(item, summary, "string"), F.lit(""))), 1, SUMMARY_CHARS)
         if summary else F.lit("")).alias("summary"),
    )
    return made.filter((F.col("title") != "") & F.col("url").isNotNull()).drop(body)


_LIST = "array<struct<path:array<string>,head:string>>"


def _lists_below(node: Column, depth: int) -> Column:
    """Lists of objects inside a JSON text in the order of its keys: path and text of the first element.

    The text of a field keeps its key order, its variant tells strings from lists and objects.
    """
    texts = F.map_entries(F.from_json(node, "map<string,string>"))
    values = F.map_values(F.from_json(node, "map<string,variant>"))
    fields = F.zip_with(texts, values, lambda e, v: F.struct(e["key"].alias("key"), e["value"].alias("text"), v.alias("value")))
    none = F.array().cast(_LIST)

    def below(field: Column) -> Column:
        own = F.array(F.struct(F.array(field["key"]).alias("path"), _first_element(field["text"]).alias("head"))).cast(_LIST)
        case = F.when(_holds_objects(field["value"]), own)
        if depth > 1:
            inner = F.transform(_lists_below(field["text"], depth - 1), lambda found: F.struct(
                F.concat(F.array(field["key"]), found["path"]).alias("path"), found["head"].alias("head"))).cast(_LIST)
            case = case.when(F.try_variant_get(field["value"], "$", "map<string,variant>").isNotNull(), inner)
        return case.otherwise(none)

    return F.coalesce(F.flatten(F.transform(fields, below)), none)


def _holds_objects(value: Column) -> Column:
    return F.try_variant_get(value, "$[0]", "map<string,variant>").isNotNull()


def _first_element(text: Column) -> Column:
    return F.get(F.from_json(text, "array<string>"), F.lit(0))


def _field_named(names: Column, ranked: tuple[str, ...], default: str) -> Column:
    """The spelling of the first ranked name that is there, else the default."""
    def spelled(wanted: str) -> Column:
        return F.try_element_at(F.filter(names, lambda n: F.lower(n) == wanted), F.lit(-1))

    return F.coalesce(*map(spelled, ranked), F.lit(default))


def payload_shape(body: Column, depth: int = 3) -> Column:
    """(list_path, title_field, link_field, summary_field) of one payload.

    The list is the first of objects in key order, at most `depth` levels down; a payload without
    one, or an unreadable one, has the empty path and the default names.
    """
    doc = F.try_parse_json(body)
    readable = F.when(doc.isNotNull(), body)
    found = F.when(_holds_objects(doc), F.struct(F.array().cast("array<string>").alias("path"), _first_element(readable).alias("head"))
                   ).otherwise(F.get(_lists_below(readable, depth), F.lit(0)))

    def shape(found: Column) -> Column:
        names = F.map_keys(F.from_json(found["head"], "map<string,string>"))
        return F.struct(
            F.coalesce(F.array_join(found["path"], "."), F.lit("")).alias("list_path"),
            _field_named(names, TITLE_FIELDS, "title").alias("title_field"),
            _field_named(names, LINK_FIELDS, "url").alias("link_field"),
            _field_named(names, SUMMARY_FIELDS, "").alias("summary_field"))

    return let(shape, found=found)


def infer_shape(payloads: DataFrame, source: str, body: str = "body") -> DataFrame:
    """Most frequent list path and field names per source (ties: smallest).

    Key order decides. Counting is a partial aggregate.
    """
    shaped = payloads.select(source, payload_shape(F.col(body)).alias("shape"))
    counted = shaped.groupBy(source, "shape").agg(F.count("*").alias("payloads"))
    best = counted.groupBy(source).agg(
        F.min(F.struct((-F.col("payloads")).alias("rank"), F.col("shape"))).alias("best"),
        F.sum("payloads").alias("payloads"))
    return best.select(source, "best.shape.*", "payloads")
