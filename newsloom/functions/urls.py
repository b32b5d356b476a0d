"""URL column expressions: normal form, hash, resolution against a base, validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import strip

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def _authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def _query(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)


def _decode(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))


def _encode(part: Column) -> Column:
    """Form encoding: unlike Java's encoder, `~` stays and `*` is escaped."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _sorted_query(query: Column) -> Column:
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    parsed = F.transform(
        pieces,
        lambda p, i: F.struct(
            _decode(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("k"),
            i.alias("i"),
            _decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    return F.array_join(
        F.transform(F.sort_array(parsed), lambda q: F.concat(_encode(q["k"]), F.lit("="), _encode(q["v"]))), "&"
    )


def normalize_url(raw: Column) -> Column:
    """Lower scheme and host, no fragment or `;params`, no trailing slash, sorted query."""
    url = strip(raw)
    path = F.regexp_replace(F.regexp_replace(_path(url), ";[^/]*$", ""), "/+$", "")
    query = _sorted_query(_query(url))
    return F.concat(
        _scheme(url), F.lit("://"), F.lower(_authority(url)),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )


def url_hash(raw: Column) -> Column:
    return F.sha2(normalize_url(raw), 256)


def is_valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


def _join_paths(base_path: Column, path: Column) -> Column:
    parts = F.split(base_path, "/")
    parent = F.when(F.element_at(parts, -1) != "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(
        F.concat(parent, F.split(path, "/")))
    last = F.element_at(segments, -1)
    middle = F.filter(F.slice(segments, 2, F.greatest(F.size(segments) - 2, F.lit(0))), lambda s: s != "")
    tidy = F.when(F.size(segments) > 1, F.concat(F.slice(segments, 1, 1), middle, F.array(last))).otherwise(segments)
    walked = F.aggregate(
        tidy,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    full = F.when(last.isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    joined = F.array_join(full, "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve_url(base: Column, href: Column) -> Column:
    """Reference resolution of `href` against an absolute http(s) `base`."""
    tail = F.regexp_extract(href, r"(?s)([?#].*)$", 1)
    path = F.regexp_extract(href, r"(?s)^([^?#]*)", 1)
    origin = F.concat(_scheme(base), F.lit("://"), _authority(base))
    base_query = _query(base)
    kept_query = F.when(base_query == "", F.lit("")).otherwise(F.concat(F.lit("?"), base_query))
    return (
        F.when(href == "", base)
        .when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(_scheme(base), F.lit(":"), href))
        .when(href.startswith("?"), F.concat(origin, _path(base), tail))
        .when(href.startswith("#"), F.concat(origin, _path(base), kept_query, tail))
        .otherwise(F.concat(origin, _join_paths(_path(base), path), tail))
    )


def prefixed_link(selector: str, value: Column, base: Column) -> Column:
    """Link rule of a JSON source: `PREF:prefix|path` glues a prefix, else resolve; NULL if unusable.

    `value` is the already extracted field (see `link_path`).
    """
    if selector.startswith("PREF:"):
        link = F.concat(F.lit(selector[5:].split("|", 1)[0]), value)
    else:
        clean = strip(value)
        link = F.when(clean == "", None).when(clean.startswith("http"), clean).otherwise(resolve_url(base, clean))
    return F.when(link.startswith("http"), link)


def link_path(selector: str) -> str:
    """The JSON path inside a link selector."""
    if selector.startswith("PREF:"):
        return (selector[5:].split("|", 1) + [""])[1]
    return selector
