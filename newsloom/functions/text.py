"""Text column expressions: normalising, tokens, character n-grams, set similarity.

Everything is a JVM expression except `to_nfc`, which needs Python because Spark
has no Unicode normaliser; it ships only the rows that hold a combining mark.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no topic in a news title.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "to", "of", "in", "for", "on", "with",
    "at", "by", "from", "as", "into", "through", "during", "before", "after",
    "and", "or", "but", "if", "not", "no", "so", "than", "too", "very",
    "just", "about", "up", "down", "out", "all", "any", "each", "every",
    "this", "that", "these", "those", "it", "its", "they", "them", "their",
    "we", "us", "our", "you", "your", "he", "him", "his", "she", "her",
    "what", "which", "who", "whom", "when", "where", "why", "how",
    "new", "latest", "announces", "announced", "launches", "launched",
    "introduces", "introduced", "reveals", "revealed", "releases", "released",
)
# Default title threshold and n-gram width.
TITLE_THRESHOLD = 0.35
NGRAM = 2

NON_WORD = r"[^\p{L}\p{N}_]"
EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def let(body: Callable[..., Column], **values: Column) -> Column:
    """`body` over named values that are computed once per row.

    Inside a lambda, or when a struct is taken apart, Spark would otherwise evaluate an
    expression again at every use.
    """
    bound = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(bound, lambda s: body(**{k: s[k] for k in values})), F.lit(0))


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def to_nfc(text: Column) -> Column:
    """NFC form. Rows without a combining mark travel to Python as NULL."""
    return F.coalesce(_compose(F.when(text.rlike(r"\p{M}"), text)), text)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind (Spark's trim only knows blanks)."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def normalize_text(text: Column) -> Column:
    """Lower case, every run of non-word characters becomes one blank. Expects NFC text."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NON_WORD + "+", " "))


def tokens_of(normalized: Column) -> Column:
    """Distinct tokens of already normalised text, without stop words and single letters."""
    return F.array_distinct(
        F.filter(F.split(normalized, " "), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))
    )


def tokenize(text: Column) -> Column:
    """Tokens of any text, composed first; not for use inside a lambda, where no UDF can stand."""
    return tokens_of(normalize_text(to_nfc(text)))


def keywords(title: Column, count: int = 5) -> Column:
    """The first `count` tokens longer than three letters, by position in the title."""
    return F.slice(F.filter(tokenize(title), lambda t: F.length(t) > 3), 1, count)


def char_ngrams(text: Column, n: int = NGRAM) -> Column:
    """Distinct character n-grams of the lower-cased word characters.

    A text shorter than n yields itself; an empty text yields no n-gram. Overlapping
    grams come from one look-ahead scan, so the cost is linear in the text length.
    """
    def grams(clean: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(clean, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
        return F.when(F.length(clean) < n, F.array(clean)).otherwise(found)

    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        let(grams, clean=F.regexp_replace(F.lower(text), NON_WORD, "")))


def bigram_codes(text: Column) -> Column:
    """The bigrams of `char_ngrams` as numbers, one for each pair of code points: sets of numbers meet much faster."""
    def code(g: Column) -> Column:
        return F.ascii(g).cast("bigint") * F.lit(1 << 21) + F.ascii(F.substring(g, 2, 1))

    return F.transform(char_ngrams(text, 2), code)


def set_jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| of two arrays of distinct values; 0 when either is empty."""
    counts = let(
        lambda a, b: F.struct(F.size(F.array_intersect(a, b)).alias("common"), (F.size(a) + F.size(b)).alias("sizes")), a=a, b=b)
    return let(lambda n: F.when(n["common"] > 0, n["common"] / (n["sizes"] - n["common"])).otherwise(0.0), n=counts)


def title_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(tokenize(a), tokenize(b))


def is_similar(a: Column, b: Column, threshold: float = TITLE_THRESHOLD) -> Column:
    return title_jaccard(a, b) >= threshold


def ngram_similarity(a: Column, b: Column, n: int = NGRAM) -> Column:
    return set_jaccard(char_ngrams(a, n), char_ngrams(b, n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None,
           eps: float = 0.0) -> Column:
    """Cosine clamped to [0, 1]; 0 where a vector is missing, zero or of another length.

    Pass precomputed norms when a vector meets many others.
    """
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b) + F.lit(eps)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(dot(a, b), size), F.lit(0.0))))


# A pluggable similarity takes two columns and returns a column in [0, 1].
Similarity = Callable[[Column, Column], Column]
SIMILARITIES: dict[str, Similarity] = {"ngram": ngram_similarity, "embedding": cosine}


def similarity_named(name: str | None) -> Similarity:
    """Choose a similarity by name; an unknown name falls back to n-grams."""
    return SIMILARITIES.get(name or "ngram", ngram_similarity)


def strip_tags(html: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", ""))


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    """True when any literal occurs in `text` (already lower-cased)."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | text.contains(needle)
    return hit


def matches_keywords(title: Column, summary: Column, words: Column) -> Column:
    """Keyword filter: any non-blank keyword inside title or summary; none given keeps all."""
    usable = F.filter(F.transform(F.coalesce(words, F.array().cast("array<string>")),
                                  lambda w: strip(F.lower(w))), lambda w: w != "")
    return let(
        lambda words, title, summary: (F.size(words) == 0) | F.exists(
            words, lambda w: F.contains(title, w) | F.contains(summary, w)),
        words=usable, title=F.lower(title), summary=F.lower(F.coalesce(summary, F.lit(""))))
