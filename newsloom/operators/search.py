"""Item pages, phrase and substring search, counts and flags per item."""

from __future__ import annotations

import string
import sys
import unicodedata
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.times import moment

INDEX_BUCKETS = 128


def _accent_table() -> tuple[str, str]:
    """Every character whose decomposition is one base letter plus marks, and that letter."""
    source, target = [], []
    for code in range(0xC0, sys.maxunicode + 1):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]) and not unicodedata.combining(parts[0]):
            source.append(char)
            target.append(parts[0])
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accent_table()


def fold(text: Column) -> Column:
    """Search form: lower case, no diacritics, letters and digits separated by single blanks."""
    low = F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), r"\p{M}+", "")
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))


def _has_phrase(text: Column, phrase: Column) -> Column:
    blank = F.lit(" ")
    return F.contains(F.concat(blank, fold(text), blank), F.concat(blank, phrase, blank))


def phrase_search(items: DataFrame, phrase: str) -> DataFrame:
    """Items whose title or summary holds the phrase's tokens in a row. One scan, no index."""
    wanted = fold(F.lit(phrase))
    hit = _has_phrase(F.col("title"), wanted) | _has_phrase(F.col("summary"), wanted)
    return items.filter((wanted != "") & hit)


def token_index(items: DataFrame) -> DataFrame:
    """(bucket, token, item_id, field, position) of every token of every title and summary."""
    fields = F.array(
        F.struct(F.lit("title").alias("field"), F.split(fold(F.col("title")), " ").alias("tokens")),
        F.struct(F.lit("summary").alias("field"), F.split(fold(F.col("summary")), " ").alias("tokens")))
    rows = items.select("item_id", F.explode(fields).alias("f")).select(
        "item_id", "f.field", F.posexplode("f.tokens").alias("position", "token")).filter(F.col("token") != "")
    return rows.select(_bucket(F.col("token")).alias("bucket"), "token", "item_id", "field", "position")


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(INDEX_BUCKETS)).cast("int")


def write_token_index(index: DataFrame, path: str, files: int = 1) -> None:
    """Store by bucket, in at most `files` files each and sorted by token, so that a search reads only
    the folders, and in them the row groups, of its tokens. Raise `files` with the data."""
    part = F.pmod(F.xxhash64("item_id"), F.lit(files))
    index.repartition("bucket", part).sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(path)


def phrase_search_indexed(index: DataFrame, phrase: str) -> DataFrame:
    """item_id of phrase hits from a token index.

    Each token occurrence votes for the position where the phrase would start; a start with
    one vote per phrase token is a hit. Reads only matching rows, one partial aggregate.
    """
    words = [w for w in _folded(phrase).split(" ") if w]
    if not words:
        return index.select("item_id").limit(0)
    slots = F.array(*[F.struct(F.lit(w).alias("token"), F.lit(i).alias("slot")) for i, w in enumerate(words)])
    # The buckets fold to constants, so a stored index is pruned to their folders.
    rows = index.filter(F.col("bucket").isin(*[_bucket(F.lit(w)) for w in sorted(set(words))]) & F.col("token").isin(*set(words)))
    rows = rows.withColumn("_slot", F.explode(F.filter(slots, lambda s: s["token"] == F.col("token"))))
    starts = rows.groupBy("item_id", "field", (F.col("position") - F.col("_slot.slot")).alias("start")).agg(
        F.count("*").alias("votes"))
    return starts.filter(F.col("votes") == len(words)).select("item_id").distinct()


def _folded(text: str) -> str:
    plain = text.lower().translate(str.maketrans(ACCENTED, PLAIN))
    kept = "".join("" if unicodedata.combining(c) else (c if c.isalnum() else " ") for c in plain)
    return " ".join(kept.split())


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def substring_search(items: DataFrame, needle: str) -> DataFrame:
    """Literal substring of title or summary; only ASCII letters ignore case, no wildcards."""
    wanted = ascii_lower(F.lit(needle))
    return items.filter(F.contains(ascii_lower(F.col("title")), wanted)
                        | F.contains(ascii_lower(F.coalesce("summary", F.lit(""))), wanted))


GRAM = 3


def _grams(text: Column) -> Column:
    """Distinct runs of GRAM characters of the text as `substring_search` compares it."""
    # One pass whatever the length: a look ahead at each place. Between the halves of a pair of surrogates it
    # adds a run that no needle has.
    ahead = F.lit("(?s)(?=(.{%d}))" % GRAM)
    return F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), ahead, F.lit(1)))


def gram_index(items: DataFrame) -> DataFrame:
    """(bucket, token, item_id, field): each run of three characters of a title or summary once.

    Store it with `write_token_index`. Texts below three characters have no rows; no needle that an index answers is in them.
    """
    fields = F.array(F.struct(F.lit("title").alias("field"), _grams(F.col("title")).alias("grams")),
                     F.struct(F.lit("summary").alias("field"), _grams(F.col("summary")).alias("grams")))
    rows = items.select("item_id", F.inline(fields)).select("item_id", "field", F.explode("grams").alias("token"))
    return rows.select(_bucket(F.col("token")).alias("bucket"), "token", "item_id", "field")


def substring_search_indexed(index: DataFrame, items: DataFrame, needle: str) -> DataFrame:
    """`substring_search` from a stored gram index: only items that hold all runs of the needle are compared.

    The index is read in the buckets of these runs. A needle below three characters has no runs and
    takes the scan. Each text adds a run once, so counting rows finds the texts that hold all of them.
    """
    low = needle.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    grams = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not grams:
        return substring_search(items, needle)
    rows = index.filter(F.col("bucket").isin(*[_bucket(F.lit(g)) for g in grams]) & F.col("token").isin(*grams))
    full = rows.groupBy("item_id", "field").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams))
    return substring_search(items.join(full.select("item_id"), "item_id", "left_semi"), needle)


def item_page(items: DataFrame, tasks: DataFrame, task_id: str | None = None, starred: bool | None = None,
              read: bool | None = None, created_after: str | datetime | None = None, page: int = 1,
              per_page: int = 20) -> DataFrame:
    """A page of items, newest first, with source name and the total before paging."""
    rows = items
    if task_id is not None:
        rows = rows.filter(F.col("task_id") == task_id)
    if starred is not None:
        rows = rows.filter(F.col("is_starred") == starred)
    if read is not None:
        rows = rows.filter(F.col("is_read") == read)
    if created_after is not None:
        rows = rows.filter(F.col("created_at") >= moment(created_after))
    total = rows.agg(F.count("*").alias("n")).scalar()
    paged = rows.orderBy(F.col("created_at").desc(), F.col("item_id").desc()).offset((page - 1) * per_page).limit(per_page)
    named = tasks.select("task_id", F.col("name").alias("task_name"))
    return paged.join(named, "task_id", "left").withColumn("total", total)


def counts_by_source(items: DataFrame) -> DataFrame:
    return items.groupBy("task_id").agg(
        F.count("*").alias("total"), F.count_if(~F.col("is_read")).alias("unread"))


def source_groups(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """Item groups per source: size, unread, newest time and title; newest group first."""
    newest = F.struct("fetched_at", "item_id")
    grouped = items.groupBy("task_id").agg(
        F.count("*").alias("item_count"), F.count_if(~F.col("is_read")).alias("unread_count"),
        F.max("fetched_at").alias("latest_fetched_at"), F.max_by("title", newest).alias("latest_title"))
    named = tasks.select("task_id", F.col("name").alias("task_name"))
    return grouped.join(named, "task_id", "left").orderBy(F.col("latest_fetched_at").desc(), "task_id")


def apply_flag_log(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest read / star state per item from a change log (item_id, is_read, is_starred, at, seq).

    A NULL flag leaves the state as it was.
    """
    def latest(flag: str) -> Column:
        return F.max_by(flag, F.when(F.col(flag).isNotNull(), F.struct("at", "seq"))).alias(f"_{flag}")

    state = changes.groupBy("item_id").agg(latest("is_read"), latest("is_starred"))
    joined = items.join(state, "item_id", "left")
    return joined.withColumns({
        f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in ("is_read", "is_starred")}).drop("_is_read", "_is_starred")
