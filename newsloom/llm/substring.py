"""Substring deduplication by recompression.

A text is rewritten in rounds: one names runs of a repeated word, each further round names pairs
whose left symbol falls into one half of the alphabet and whose right symbol into the other. A
name is a hash of what it stands for, so all tasks give equal runs and pairs the same name with
no dictionary. Whether a symbol forms depends on its neighbours only; the words it depended on
are tracked. Equal word sequences therefore hold the same symbols wherever those depend on words
inside the sequence alone. Each window's witness is its leftmost such symbol of the highest
round that has one, so equal windows have equal witnesses, at most one for several words. Spark
finds the witnesses that occur more than once; only windows around those are compared, by 96
bits mixed from the 128-bit digests of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm import common
from newsloom.llm.words import Words, mix, sequence_hash, words

ROUNDS = 6
U = np.uint64


def _mix2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(0x9E3779B97F4A7C15) ^ mix(b + U(0xD1B54A32D192ED03)))


def levels(found: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names, first word depended on, word after the last) per round, lowest round first.

    Beyond the ends of a text stand words that no window holds.
    """
    n = len(found.hashes)
    text_of = np.repeat(np.arange(len(found)), found.counts)
    names, low, high = found.hashes, np.arange(n), np.arange(1, n + 1)
    yield names, low, high
    if n == 0:
        return
    start = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (text_of[1:] != text_of[:-1])))
    length = np.diff(np.append(start, n))
    names = np.where(length > 1, _mix2(names[start], length.astype(U)), names[start])
    low, high, text_of = start - 1, start + length + 1, text_of[start]
    begin, end = found.first[:-1], found.first[1:]
    yield names, low, high
    for r in range(ROUNDS):
        right = (mix(names ^ mix(np.array([r + 1], U))) >> U(63)).astype(bool)
        same = text_of[1:] == text_of[:-1]
        merged = np.append(~right[:-1] & right[1:] & same, False)
        second = np.append(False, merged[:-1])
        # An unmerged left symbol depends on what follows, an unmerged right one on what precedes.
        low_before = np.append(-1, np.where(same, low[:-1], begin[text_of[1:]] - 1))
        high_after = np.append(np.where(same, high[1:], end[text_of[:-1]] + 1), n + 1)
        new_low = np.where(right & ~merged, np.minimum(low, low_before), low)
        new_high = np.where(~right, np.maximum(high, high_after), high)
        new_names = names.copy()
        at = np.flatnonzero(merged)
        new_names[at] = _mix2(names[at], names[at + 1])
        keep = ~second
        names, low, high, text_of = new_names[keep], new_low[keep], new_high[keep], text_of[keep]
        yield names, low, high


def witnesses(found: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of all windows of `size` words, name and place of each one's witness)."""
    starts = [np.arange(a, b - size + 1) for a, b in zip(found.first[:-1], found.first[1:], strict=True) if b - a >= size]
    at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    n, out, open_ = len(found.hashes), np.zeros(len(at), U), np.ones(len(at), bool)
    place = np.zeros(len(at), np.int64)
    for number, (names, low, high) in reversed(list(enumerate(levels(found)))):
        if not open_.any():
            break
        before = np.cumsum(np.bincount(low + 1, minlength=n + 2))  # symbols that start before a word
        index = np.flatnonzero(open_)
        j = before[at[index]]
        ok = j < len(names)
        ok[ok] = high[j[ok]] <= at[index][ok] + size
        out[index[ok]] = mix(names[j[ok]] + U(number))
        place[index[ok]] = low[j[ok]]
        open_[index[ok]] = False
    return at, out, place


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _joined(texts: pa.Array) -> Iterator[bytes]:
    """Words joined by one space."""
    for text in texts.cast(pa.large_binary()):
        yield b" ".join((text.as_py() or b"").split())


def word_digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, n_words, sha256 of the words joined by one space) per row."""
    schema = pa.schema([("k", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string())])

    def make(batch: pa.RecordBatch) -> dict:
        joined = list(_joined(batch.column(1)))
        return {"k": batch.column(0), "sha": [_digest(x) for x in joined],
                "n_words": pa.array([x.count(b" ") + 1 if x else 0 for x in joined], pa.int64())}

    return docs.select(F.col(key).cast("long"), common.text_of(text)).mapInArrow(
        lambda rows: common.batches(rows, schema, make), "k long, n_words long, sha string")


def _short(sha: str) -> int:
    return int(sha[:16], 16) - (1 << 63)


def witness_rows(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(name, digest, known) of the witnesses of each word sequence.

    Within a batch a name comes out once to be compared with other batches; where it occurs twice
    in the batch, all its sequences also come out as known, so a frequent name is not dealt out
    once for every text.
    """
    schema = pa.schema([("name", pa.int64()), ("digest", pa.int64()), ("known", pa.bool_())])

    def make(batch: pa.RecordBatch) -> dict | None:
        found = words(batch.column(1))
        at, names, place = witnesses(found, size)
        if not len(at):
            return None
        text_of = np.searchsorted(found.first, at, "right") - 1
        # One occurrence of a witness serves a stretch of windows; texts with equal words are one.
        short = np.array([_short(_digest(x)) for x in _joined(batch.column(1))], np.int64)
        lead_text = np.zeros(len(short), bool)
        lead_text[np.unique(short, return_index=True)[1]] = True
        fresh = np.append(True, (names[1:] != names[:-1]) | (place[1:] != place[:-1])) & lead_text[text_of]
        names, digest = names[fresh].view(np.int64), short[text_of[fresh]]
        order = np.lexsort((digest, names))
        names, digest = names[order], digest[order]
        new = np.append(True, names[1:] != names[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        known = many & (new | np.append(True, digest[1:] != digest[:-1]))
        return {"name": np.concatenate((names[new], names[known])),
                "digest": np.concatenate((digest[new], digest[known])),
                "known": np.concatenate((np.zeros(int(new.sum()), bool), np.ones(int(known.sum()), bool)))}

    return docs.select(F.col(key).cast("long"), common.text_of(text)).mapInArrow(
        lambda rows: common.batches(rows, schema, make), "name long, digest long, known boolean")


def window_rows(docs: DataFrame, size: int) -> DataFrame:
    """(h1, h2, k, start, known) of the windows of (k, t, names) whose witness is among `names`.

    Within a batch only a window's first occurrence is left to compare; later ones are known.
    """
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("k", pa.int64()), ("start", pa.int64()),
                        ("known", pa.bool_())])

    def make(batch: pa.RecordBatch) -> dict | None:
        found = words(batch.column(1))
        at, names, _ = witnesses(found, size)
        if not len(at):
            return None
        keys = batch.column(0).to_numpy()
        text_of = np.searchsorted(found.first, at, "right") - 1
        lists = batch.column(2)
        wanted = lists.values.to_numpy()
        offsets = lists.offsets.to_numpy()
        mark = np.zeros(len(at), bool)
        cut = np.searchsorted(text_of, np.arange(batch.num_rows + 1))
        for i in range(batch.num_rows):
            low, high = cut[i], cut[i + 1]
            if high > low:
                mark[low:high] = np.isin(names[low:high].view(np.int64), wanted[offsets[i]:offsets[i + 1]])
        at, text_of = at[mark], text_of[mark]
        h1 = sequence_hash(found.hashes, at, size, 0x5851F42D4C957F2D).view(np.int64)
        h2 = (sequence_hash(found.others, at, size, 0x14057B7EF767814F) >> U(32)).astype(np.uint32).view(np.int32)
        start = at - found.first[text_of]
        order = np.lexsort((start, keys[text_of], h2, h1))
        h1, h2, k, start = h1[order], h2[order], keys[text_of][order], start[order]
        known = np.append(False, (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])) if len(h1) else np.zeros(0, bool)
        return {"h1": h1, "h2": h2, "k": k, "start": start, "known": known}

    return docs.mapInArrow(lambda rows: common.batches(rows, schema, make),
                           "h1 long, h2 int, k long, start long, known boolean")


def without_windows(docs: DataFrame, size: int) -> DataFrame:
    """(k, n_removed, sha, kept) of (k, t, starts): every word covered by a window start goes."""
    schema = pa.schema([("k", pa.int64()), ("n_removed", pa.int64()), ("sha", pa.string()), ("kept", pa.string())])

    def make(batch: pa.RecordBatch) -> dict:
        removed, sha, kept = [], [], []
        lists = batch.column(2)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
            all_words = (text.as_py() or b"").split()
            edge = np.zeros(len(all_words) + 1, np.int64)
            starts = values[offsets[i]:offsets[i + 1]]
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + size, -1)
            covered = np.cumsum(edge)[:-1] > 0
            rest = b" ".join(w for w, gone in zip(all_words, covered.tolist(), strict=True) if not gone)
            removed.append(int(covered.sum()))
            sha.append(_digest(rest))
            kept.append(rest.decode())
        return {"k": batch.column(0), "n_removed": pa.array(removed, pa.int64()), "sha": sha, "kept": kept}

    return docs.mapInArrow(lambda rows: common.batches(rows, schema, make),
                           "k long, n_removed long, sha string, kept string")


def repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 20) -> DataFrame:
    """One row per document: key, n_words, n_removed, kept_sha256.

    A word goes if a window of `size` words of its text covers it whose word sequence also starts
    earlier: in a smaller key, or earlier in the same text. Windows are judged on the input.
    A null or blank text has no words (digest of the empty string); texts shorter than a window
    keep all. Keys are unique; a row without key keeps all its words and takes away none from
    others. Other columns are not read.
    """
    none = _digest(b"")
    all_rows = common.written(word_digests(docs, key, text), "digests")
    base = all_rows.filter("k IS NOT NULL").distinct()
    owned = docs.filter(F.col(key).isNotNull())
    lead = base.filter(F.col("n_words") >= size).groupBy("sha").agg(F.min("k").alias("lead"))
    names = witness_rows(owned, key, text, size)
    # Rows known to be repeated only pass through: they are dealt out one by one, not by name.
    beside = W.partitionBy("name", F.when(F.col("known"), F.col("digest"))).orderBy("digest")
    asked = names.withColumns({"prev": F.lag("digest").over(beside), "next": F.lead("digest").over(beside)})
    found = asked.filter("known OR prev <> digest OR next <> digest").select("name", "digest")
    repeated = common.written(found, "names")
    per_text = repeated.groupBy("digest").agg(F.collect_set("name").alias("names"))
    short = F.expr("cast(cast(conv(substring(sha, 1, 16), 16, 10) as decimal(20, 0)) - 9223372036854775808 as long)")
    suspects = lead.withColumn("digest", short).join(per_text, "digest").select(F.col("lead").alias("k"), "names")
    texts = owned.select(F.col(key).cast("long").alias("k"), common.text_of(text).alias("t"))
    windows = window_rows(texts.join(suspects.hint("merge"), "k").select("k", "t", "names"), size)
    first = W.partitionBy("h1", "h2", F.when(F.col("known"), F.struct("k", "start"))).orderBy("k", "start")
    later = windows.withColumn("prev", F.lag("k").over(first)).filter("known OR prev IS NOT NULL")
    starts = common.written(later.groupBy("k").agg(F.collect_list("start").alias("starts")), "starts")
    cut = without_windows(texts.join(starts.hint("merge"), "k").select("k", "t", "starts"), size)
    joined = (base.join(lead, "sha", "left").withColumnRenamed("sha", "all_sha")
              .join(cut.select("k", "n_removed", "sha"), "k", "left"))
    copy = F.coalesce(F.col("k") > F.col("lead"), F.lit(False))
    kept = joined.select(
        "k", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(none)).otherwise(F.coalesce("sha", "all_sha")).alias("kept_sha256"))
    unowned = all_rows.filter("k IS NULL").select(
        "k", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return kept.union(unowned).withColumnRenamed("k", key)
