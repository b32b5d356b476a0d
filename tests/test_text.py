"""Column expressions against plain Python."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import parse_qs, urlencode, urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from newsloom.functions import entities, labels, text, times, urls

C = F.col


def test_normalize_and_nfc(one):
    assert one(text.normalize_text(C("t")), t="  Hello,   World! ") == "hello world"
    assert one(text.normalize_text(text.to_nfc(C("t"))), t="Café!") == "café"
    assert one(text.normalize_text(C("t")), t="GPT-5 发布") == "gpt 5 发布"
    assert one(text.normalize_text(C("t")), t="snake_case x") == "snake_case x"


def test_tokens(one):
    assert one(F.sort_array(text.tokenize(C("t"))), t="The new Rust release of a Rust tool") == ["release", "rust", "tool"]
    assert one(text.tokenize(C("t")), t="the a of") == []
    assert one(text.keywords(C("t")), t="alpha beta gamma cat delta omega kappa") == ["alpha", "beta", "gamma", "delta", "omega"]


@pytest.mark.parametrize("a, b, want", [
    ("openai gpt5", "openai gpt5", 1.0), ("openai", "google", 0.0), ("", "x", 0.0), ("the", "the", 0.0),
    ("alpha beta gamma", "alpha beta delta", 0.5)])
def test_jaccard(one, a, b, want):
    assert one(text.title_jaccard(C("a"), C("b")), a=a, b=b) == pytest.approx(want)
    assert one(text.is_similar(C("a"), C("b")), a=a, b=b) == (want >= 0.35)


def grams(t, n=2):
    if not t:
        return set()
    clean = re.sub(r"[^\w]", "", t.lower())
    return {clean} if len(clean) < n else {clean[i:i + n] for i in range(len(clean) - n + 1)}


@pytest.mark.parametrize("t", ["", "a", "!!", "ab", "Hello World", "机器学习", "naïve café", "a😀b"])
def test_ngrams(one, t):
    want = grams(t)
    if "😀" in t:
        want = {"ab"}
    assert set(one(text.char_ngrams(C("t")), t=t)) == want


def test_ngram_similarity(one):
    assert one(text.ngram_similarity(C("a"), C("b")), a="hello", b="hello") == 1.0
    assert one(text.ngram_similarity(C("a"), C("b")), a="", b="hello") == 0.0
    assert one(text.ngram_similarity(C("a"), C("b")), a="!!", b="??") == 1.0
    assert text.similarity_named("no such") is text.ngram_similarity


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]),
                                (None, [1.0]), ([0.0], [1.0]), ([1.0], [1.0, 0.0]), ([], [])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(text.cosine(C("a"), C("b"))).collect()] == [1.0] + [0.0] * 6


def test_keyword_filter(one):
    assert one(text.matches_keywords(C("t"), C("s"), C("k")), t="Big News", s=None, k=[" news "]) is True
    assert one(text.matches_keywords(C("t"), C("s"), C("k")), t="Big", s="thing", k=["news"]) is False
    assert one(text.matches_keywords(C("t"), C("s"), C("k")), t="Big", s="thing", k=["  "]) is True


URLS = [
    "HTTP://Example.COM/Path/?b=2&a=1#frag", "https://example.com", "https://example.com///", "https://e.com/a;p=1?x",
    "https://e.com/a/b/?q=a+b&q=%7Ez&k=*&empty=", "http://e.com/?z=1&&a=%E4%B8%AD", "  https://e.com/x/  ",
    "https://e.com/a;b/c;d?y=1", "https://E.com:8080/?a", "https://e.com/p?a=b=c"]


def plain_normal(raw):
    p = urlparse(raw.strip())
    query = urlencode(sorted(parse_qs(p.query, keep_blank_values=True).items()), doseq=True)
    return f"{p.scheme.lower()}://{p.netloc.lower()}{p.path.rstrip('/') or '/'}" + (f"?{query}" if query else "")


@pytest.mark.parametrize("raw", URLS)
def test_normalize_url(one, raw):
    assert one(urls.normalize_url(C("u")), u=raw) == plain_normal(raw)


@pytest.mark.parametrize("href", ["/x", "x", "../x", "./x/../y", "?q=1", "#top", "//cdn.e.org/z", "https://o.org/a/../b", "", "a//b", "../../../x", "x/..", "."])
@pytest.mark.parametrize("base", ["https://e.com/en/list/page.html?k=1#f", "https://e.com", "https://e.com/a/"])
def test_resolve_url(one, base, href):
    assert one(urls.resolve_url(C("b"), C("h")), b=base, h=href) == urljoin(base, href)


def test_valid_url(one):
    assert one(urls.is_valid_url(C("u")), u="https://e.com/x") is True
    for bad in ("ftp://e.com", "https://", "e.com", "http:/e"):
        assert one(urls.is_valid_url(C("u")), u=bad) is False


def test_prefixed_link(one):
    assert one(urls.prefixed_link("PREF:https://h.org/|id", C("v"), C("b")), v="7", b="") == "https://h.org/7"
    assert one(urls.prefixed_link("url", C("v"), C("b")), v=" /p ", b="https://e.com/x") == "https://e.com/p"
    assert one(urls.prefixed_link("url", C("v"), C("b")), v="  ", b="https://e.com/x") is None


def plain_repos(body):
    return list(dict.fromkeys(r for r in re.findall(r"\b([a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+)\b", body) if not r.startswith("http")))


def test_entities_match_plain_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", "text", entities.repositories(C("text")).alias("repo"), entities.numbers(C("text")).alias("num"),
                       entities.versions(C("text")).alias("ver")).collect()
    for r in rows:
        assert r["repo"] == plain_repos(r["text"])
        assert r["num"] == list(dict.fromkeys(
            n for n in re.findall(r"\b(\d+(?:\.\d+)?[MBKmbk]?)\b", r["text"]) if len(n) > 1 and not n.startswith("0")))
        assert r["ver"] == list(dict.fromkeys(m[0] for m in re.finditer(r"\bv?(\d+\.\d+(?:\.\d+)?)\b", r["text"])))


def test_entities(spark):
    df = spark.createDataFrame([("OpenAI ships GPT-4o v1.2.3", "see rust-lang/rust, été/abc, Sep 15, 2026 and 2026-09-15: 100 users, 05")], "t string, s string")
    e = df.select(entities.extract_entities(C("t"), C("s")).alias("e")).first()["e"]
    assert e["company"] == ["openai", "x"] or e["company"] == ["openai"]
    assert e["ai_model"] == ["gpt-4", "gpt-4o"]
    assert "rust-lang/rust" in e["github_repo"]
    assert e["version"] == ["v1.2.3"]
    assert e["date"] == ["2026-09-15", "Sep 15, 2026"]
    assert e["person"] == []
    whole = df.select(entities.known_names(F.concat_ws(" ", "t", "s"), ["go", "rust"], "word").alias("n")).first()["n"]
    assert whole == ["rust"]


def test_entity_overlap(spark):
    df = spark.createDataFrame([("openai and rust", "openai and google")], "a string, b string")
    pair = df.select(entities.extract_entities(C("a"), F.lit("")).alias("ea"), entities.extract_entities(C("b"), F.lit("")).alias("eb"))
    got = pair.select(entities.entity_overlap(C("ea"), C("eb")).alias("o"), "ea", "eb").first()
    want = sum(len(set(got["ea"][k]) & set(got["eb"][k])) / len(set(got["ea"][k]) | set(got["eb"][k]))
               for k in entities.ENTITY_TYPES if got["ea"][k] and got["eb"][k]) / 9
    assert got["o"] == pytest.approx(want)


@pytest.mark.parametrize("raw, code", [
    (None, "UNKNOWN"), ("  ", "UNKNOWN"), ("任务配置不完整：缺少 来源 URL", "CONFIG_INCOMPLETE"), ("SSRF blocked: x", "SSRF_BLOCKED"),
    ("Task is paused", "TASK_PAUSED"), ("task not found", "TASK_NOT_FOUND"), ("Response too large", "RESPONSE_TOO_LARGE"),
    ("failed after 3 attempt(s), last error: HTTP 404 Not Found", "HTTP_404"), ("HTTP 503 x", "HTTP_503"), ("HTTP 418", "HTTP_418"),
    ("Timeout after 15.0s", "TIMEOUT"), ("SSL: certificate verify failed", "NETWORK"), ("Connection error", "NETWORK"), ("boom", "INTERNAL")])
def test_error_class(one, raw, code):
    got = one(labels.classify_error(C("e")), e=raw)
    assert got["code"] == code and got["hint"]
    if code == "HTTP_418":
        assert "418" in got["hint"]


def test_labels(one):
    assert one(labels.language(C("t")), t="机器学习 ai") == "zh"
    assert one(labels.language(C("t")), t=" \t ") == "unknown"
    assert one(labels.content_type(C("t"), C("s")), t="How to launch", s="") == "release"
    assert one(labels.event_type(C("t"), C("s")), t="Breaking: release", s="") == "breaking_news"
    assert one(labels.event_window_hours(labels.event_type(C("t"), C("s"))), t="GitHub trending", s=None) == 336.0
    assert one(labels.source_novelty(C("a"), C("p")), a="x", p=["x"]) == 0.3
    assert one(labels.source_novelty(C("a"), C("p")), a="y", p=["x"]) == 1.0
    assert one(labels.source_novelty(C("a"), C("p")), a=None, p=["x"]) == 0.5
    assert one(labels.source_novelty(C("a"), C("p")), a="y", p=[]) == 1.0
    for score, label in ((0.7, "high"), (0.69, "medium"), (0.45, "medium"), (0.1, "low")):
        assert one(labels.confidence(C("s")), s=score) == label


def test_times(one):
    iso = lambda c: times.parse_iso(C(c)).cast("string")
    assert one(iso("t"), t="2026-09-15T10:00:00Z") == "2026-09-15 10:00:00"
    assert one(iso("t"), t="2026-09-15T10:00:00+02:00") == "2026-09-15 08:00:00"
    assert one(iso("t"), t="2026-09-15 10:00:00") == "2026-09-15 10:00:00"
    assert one(iso("t"), t="yesterday") is None
    assert one(times.age_hours(times.parse_iso(C("t")), "2026-09-15 00:00:00"), t="nonsense") == 999.0
    for hours, want in ((6.0, 1.0), (24.0, 0.8), (72.0, 0.5), (72.1, 0.1)):
        assert one(times.temporal_steps(C("h")), h=hours) == want
    gap = lambda w: times.temporal_score(times.parse_iso(C("a")), times.parse_iso(C("b")), F.lit(w))
    assert one(gap(168.0), a="2026-01-01T00:00:00Z", b="2026-01-05T00:00:00Z") == 0.3
    assert one(gap(24.0), a="2026-01-01T00:00:00Z", b="2026-01-05T00:00:00Z") == 0.1
    assert one(gap(24.0), a=None, b="2026-01-05T00:00:00Z") == 0.0
    assert one(times.rfc822(times.parse_iso(C("t"))), t="2026-09-15T10:00:00Z") == "Tue, 15 Sep 2026 10:00:00 +0000"


def test_strip_tags(one):
    assert one(text.strip_tags(C("h")), h=" <p>a <b>b</b></p>\n") == "a b"
    assert unicodedata.normalize("NFC", "é") == "é"


def test_own_dictionary(spark):
    from newsloom.operators.features import item_features
    df = spark.createDataFrame([("Acme buys Initech", None)], "title string, summary string")
    f = item_features(df, match="word", dictionaries={"company": ["acme", "buy"]}).first()["features"]
    assert f["entities"]["company"] == ["acme"] and f["title_tokens"] == ["acme", "buys", "initech"]


def test_dictionary_table(spark):
    from newsloom.operators.dictionary import dictionary_entities
    items = spark.createDataFrame([(1, "OpenAI ships GPT-4", "in r, go"), (2, "nothing", None), (3, "C++ and go.", "x"), (4, None, None)],
                                  "item_id int, title string, summary string")
    names = spark.createDataFrame([("company", "OpenAI"), ("company", "x"), ("language", "go"), ("language", "r"), ("language", "c++"),
                                   ("language", " "), ("language", None), ("model", "gpt-4"), ("model", "GPT-4"), ("place", "thing")],
                                  "entity_type string, name string")
    got = {(r["item_id"], r["entity_type"]): r["names"] for r in dictionary_entities(items, names).collect()}
    assert got == {(1, "company"): ["openai"], (1, "language"): ["go", "r"], (1, "model"): ["gpt-4"], (2, "place"): ["thing"],
                   (3, "company"): ["x"], (3, "language"): ["c++", "go"]}
    words = {(r["item_id"], r["entity_type"]): r["names"] for r in dictionary_entities(items, names, "word").collect()}
    assert words == {(1, "company"): ["openai"], (1, "language"): ["go", "r"], (1, "model"): ["gpt-4"], (3, "company"): ["x"],
                     (3, "language"): ["c++", "go"]}
