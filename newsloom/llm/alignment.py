"""Alignment of two tokenizers over the same bytes.

Every text is tokenised whole by a byte-level BPE (A) and a sentencepiece model (B). Where a token
of each ends at the same byte and both next tokens begin with a space, the text is cut: such
anchors are checked against the bytes, not assumed. What lies between two anchors is a window of
token ids, and how its tokens align depends on these ids alone; windows recur, so each distinct pair of
id tuples is aligned once and remembered. Texts whose tokens do not give back their bytes have none.

Counts of linked id pairs over all documents are gathered from the distinct pairs of each batch,
and handed back to the batches by (batch, place), so no document is shuffled link by link.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import common
from newsloom.llm.tokens import encoder
from newsloom.llm.words import distinct_spans, flat_bytes

CACHE_WINDOWS = 150_000
BATCH_BYTES = 4 << 20
_LOW = (1 << 32) - 1


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """Bytes of every token id, end to end."""

    flat: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    spaced: np.ndarray  # whether a token begins with a space

    @classmethod
    def of(cls, tokens: list[bytes]) -> Vocabulary:
        lengths = np.array([len(t) for t in tokens], np.int64)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths,
                   np.array([t[:1] == b" " for t in tokens], bool))

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[_spread(self.starts[ids], self.lengths[ids])]


class Pair:
    """Both tokenizers, and the windows already aligned."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = encoder(path_a, specials=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, names = _byte_letters(), self.a.library.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(names.values()) + 1)
        for name, number in names.items():
            tokens[number] = bytes(letters[c] for c in name) if all(c in letters for c in name) else b""
        self.bytes_a = Vocabulary.of(tokens)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = Vocabulary.of([bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                                      for i, p in enumerate(pieces)])
        self.memo: dict[bytes, tuple[str, int, np.ndarray]] = {}

    def aligned(self, keys: list[bytes]) -> list[tuple[str, int, np.ndarray]]:
        """(groups as text, their number, linked id pairs with repeats) of each window with these ids.

        A key holds A's ids, -1, and B's ids, as 32-bit numbers; pairs are a << 32 | b.
        """
        known = list(map(self.memo.get, keys))
        new = [i for i, k in enumerate(known) if k is None]
        if new:
            if len(self.memo) >= CACHE_WINDOWS:
                self.memo.clear()
            for i, value in zip(new, self._align([keys[i] for i in new]), strict=True):
                known[i] = self.memo[keys[i]] = value
        return known

    def _align(self, keys: list[bytes]) -> Iterator[tuple[str, int, np.ndarray]]:
        """All windows at once: both sides of each have as many bytes, so that end to end they still match."""
        flat = np.frombuffer(b"".join(keys), np.int32)
        lengths = np.array([len(k) // 4 for k in keys], np.int64)
        cut = np.flatnonzero(flat < 0)
        owner, at = _owners(lengths), np.arange(len(flat))
        in_a, in_b = at < cut[owner], at > cut[owner]
        a, b = flat[in_a].astype(np.int64), flat[in_b].astype(np.int64)
        ends_a, ends_b = np.cumsum(self.bytes_a.lengths[a]), np.cumsum(self.bytes_b.lengths[b])
        # A token of A overlaps those of B from the one that holds its first byte to the one with its last.
        low = np.searchsorted(ends_b, ends_a - self.bytes_a.lengths[a], "right")
        high = np.searchsorted(ends_b, ends_a, "left")
        counts = high - low + 1
        links = np.repeat(a << 32, counts) | b[_spread(low, counts)]
        cut_a = np.flatnonzero(ends_b[high] == ends_a) + 1
        cut_b = high[cut_a - 1] + 1
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups = [names_a[i] + "|" + names_b[k] if j - i == m - k == 1 else ",".join(names_a[i:j]) + "|" + ",".join(names_b[k:m])
                  for i, j, k, m in zip([0, *cut_a[:-1].tolist()], cut_a.tolist(), [0, *cut_b[:-1].tolist()],
                                        cut_b.tolist(), strict=True)]
        window = owner[in_a]
        last = np.cumsum(np.bincount(window[cut_a - 1], minlength=len(keys))).tolist()
        to = np.cumsum(np.bincount(window, counts, len(keys)).astype(np.int64)).tolist()
        for i, j, k, m in zip([0, *last[:-1]], last, [0, *to[:-1]], to, strict=True):
            yield ";".join(groups[i:j]), j - i, links[k:m]


@lru_cache(maxsize=1)
def pair(path_a: str, path_b: str) -> Pair:
    """One pair of tokenizers per worker."""
    return Pair(path_a, path_b)


@dataclass
class Aligned:
    """Tokens of a batch of texts; texts without tokens have none here either."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    first_a: np.ndarray     # number of A's tokens before each text, and in all
    first_b: np.ndarray
    windows: np.ndarray     # number of each window among the distinct ones
    first_window: np.ndarray
    keys: list[bytes]       # id tuples of the distinct windows


def _first(counts: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(counts)).astype(np.int64)


def _owners(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of counts[i] numbers each."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _gives_back(ids: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text whether its tokens' bytes are its own."""
    sizes = np.bincount(_owners(counts), vocabulary.lengths[ids], len(counts)).astype(np.int64)
    good = sizes == np.diff(offsets)
    made = vocabulary.joined(ids[np.repeat(good, counts)])
    wanted = data[np.repeat(good, np.diff(offsets))]
    wrong = np.bincount(_owners(sizes[good]), made != wanted, int(good.sum()))
    good[good] = wrong == 0
    return good


def tokenised(texts: pa.Array, both: Pair) -> Aligned:
    """Tokens and windows of texts; a null text is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    filled = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    spaced = pc.if_else(pa.array(filled), pc.binary_join_element_wise(space, texts, nothing), texts)
    parts_a = both.a.encode_all(spaced)
    parts_b = [np.array(x, np.int64) for x in both.b.encode(texts.to_pylist(), out_type=int, num_threads=1)]
    counts_a = np.array([len(x) for x in parts_a], np.int64) * filled
    counts_b = np.array([len(x) for x in parts_b], np.int64) * filled
    none = np.zeros(0, np.int64)
    ids_a = np.concatenate([none, *(x for x, f in zip(parts_a, filled, strict=True) if f)]).astype(np.int64)
    ids_b = np.concatenate([none, *(x for x, f in zip(parts_b, filled, strict=True) if f)]).astype(np.int64)
    data, offsets = flat_bytes(spaced)
    good = (_gives_back(ids_a, counts_a, both.bytes_a, data, offsets)
            & _gives_back(ids_b, counts_b, both.bytes_b, data, offsets))
    ids_a, ids_b = ids_a[np.repeat(good, counts_a)], ids_b[np.repeat(good, counts_b)]
    counts_a, counts_b = counts_a * good, counts_b * good
    ends_a, ends_b = np.cumsum(both.bytes_a.lengths[ids_a]), np.cumsum(both.bytes_b.lengths[ids_b])
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b) + 1, bool)
    last_a[np.cumsum(counts_a)[counts_a > 0] - 1] = True
    # Places where tokens of both end, and of those the anchors: text ends, and where both go on with a space.
    place = np.searchsorted(ends_b, ends_a)
    shared = ends_b[place] == ends_a if len(ids_a) else last_a
    open_a = np.append(both.bytes_a.spaced[ids_a[1:]], True) if len(ids_a) else last_a
    open_b = np.append(both.bytes_b.spaced[ids_b[1:]], True) if len(ids_b) else last_b[:0]
    anchor = shared & (last_a | (open_a & open_b[place])) if len(ids_a) else last_a
    after_a, after_b = np.flatnonzero(anchor) + 1, place[anchor] + 1
    n_a, n_b = np.diff(after_a, prepend=0), np.diff(after_b, prepend=0)
    lengths = n_a + n_b + 1
    base = np.cumsum(lengths) - lengths
    flat = np.full(int(lengths.sum()), -1, np.int32)
    flat[_spread(base, n_a)], flat[_spread(base + n_a + 1, n_b)] = ids_a, ids_b
    first_a = _first(counts_a)
    codes, keys = distinct_spans(flat.view(np.uint8), 4 * np.cumsum(lengths)) if len(lengths) else (none, [])
    return Aligned(ids_a, ids_b, first_a, _first(counts_b), codes,
                   np.searchsorted(after_a, first_a, "right") if len(after_a) else np.zeros(len(first_a), np.int64), keys)


def _lists(first: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32)))


_LIST = pa.list_(pa.int32())
_ROWS = pa.schema([("batch", pa.string()), ("k", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                   ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                   ("pairs", _LIST), ("times", _LIST), ("a", _LIST), ("b", _LIST), ("docs", _LIST)])
_ROWS_TYPE = ("batch string, k long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "pairs array<int>, times array<int>, a array<int>, b array<int>, docs array<int>")


def _batch(keys: pa.Array, texts: pa.Array, both: Pair) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Rows of the texts of a batch, and one row with its distinct linked pairs.

    A text's row has the places of its pairs among those, and how often it holds each.
    """
    found, name, n = tokenised(texts, both), uuid.uuid4().hex, len(texts)
    known = both.aligned(found.keys)
    names = [k[0] for k in known]
    groups, links = np.array([k[1] for k in known], np.int64), [k[2] for k in known]
    sizes = np.array([len(x) for x in links], np.int64)
    distinct, local = np.unique(np.concatenate([np.zeros(0, np.int64), *links]), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    per_window = sizes[found.windows]
    at = _spread(begin[found.windows], per_window)
    text_of_window = _owners(np.diff(found.first_window))
    width = max(len(distinct), 1)
    held, times = np.unique(np.repeat(text_of_window, per_window) * width + local[at], return_counts=True)
    owner, place = held // width, held % width
    first = np.searchsorted(owner, np.arange(n + 1))
    windows, cuts = found.windows.tolist(), found.first_window.tolist()
    shas = [hashlib.sha256(";".join([names[w] for w in windows[low:high]]).encode()).hexdigest() if high > low else ""
            for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
    none = pa.nulls(n, _LIST)
    rows = pa.RecordBatch.from_arrays([
        pa.array([name] * n), keys.cast(pa.int64()), pa.array(np.diff(found.first_a)), pa.array(np.diff(found.first_b)),
        pa.array(np.bincount(text_of_window, groups[found.windows], n).astype(np.int64)),
        pa.array(np.bincount(text_of_window, per_window, n).astype(np.int64)), pa.array(shas, pa.string()),
        _lists(first, place), _lists(first, times), none, none, none], schema=_ROWS)
    one = np.array([0, len(distinct)])
    pairs = pa.RecordBatch.from_arrays([
        pa.array([name]), *(pa.nulls(1, _ROWS.field(i).type) for i in range(1, 9)), _lists(one, distinct >> 32),
        _lists(one, distinct & _LOW), _lists(one, np.bincount(place, minlength=len(distinct)))], schema=_ROWS)
    return rows, pairs


def _gathered(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_BYTES, in the order of the rows."""
    held, size = [], 0
    for batch in rows:
        held.append(batch)
        size += batch.nbytes
        if size >= BATCH_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    some = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
    yield from some[:1]


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of all texts and of all batches' distinct pairs, as `_batch` gives them."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(rows):
            if batch.num_rows:
                yield from _batch(batch.column(0), batch.column(1).cast(pa.large_string()), pair(path_a, path_b))

    return docs.select(F.col(key).cast("long").alias("k"), common.text_of(text).alias("t")).mapInArrow(run, _ROWS_TYPE)


def held_pairs(rows: DataFrame) -> DataFrame:
    """(batch, place, a, b, docs) of the distinct linked pairs of each batch."""
    listed = rows.filter("a IS NOT NULL").select("batch", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("place", "p"))
    return listed.select("batch", "place", "p.a", "p.b", "p.docs")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many documents a pair is linked, and whether no pair of its A id is in more."""
    counts = common.written(held_pairs(rows).groupBy("a", "b").agg(F.sum("docs").alias("count")), "pairs")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


_RESULT = pa.schema([("k", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                     ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def _scored(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of each text of a batch, given the count of each of its pairs by place."""
    place = counts.column("place").to_numpy()
    by_place = np.zeros((2, int(place.max(initial=-1)) + 1), np.int64)
    by_place[0, place] = counts.column("count").to_numpy()
    by_place[1, place] = counts.column("best").to_numpy(zero_copy_only=False)
    rows = rows.combine_chunks()
    pairs, times = (pc.list_flatten(rows.column(c)).to_numpy() for c in ("pairs", "times"))
    owner = _owners(pc.list_value_length(rows.column("pairs")).to_numpy())
    sums = [np.zeros(rows.num_rows, np.int64) for _ in by_place]
    for out, values in zip(sums, by_place, strict=True):
        np.add.at(out, owner, values[pairs] * times)
    names = {"n_best": pa.array(sums[1]), "count_sum": pa.array(sums[0])}
    return pa.Table.from_arrays([names.get(n, rows.column(n) if n in rows.column_names else None) for n in _RESULT.names],
                                schema=_RESULT)


def alignments(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those whose tokens of A or B do not give back a space and the text,
    have zeros and ''. Rows that repeat, and rows without key, come out as often as they come in and
    count as documents each. Other columns are not read.
    """
    rows = common.written(aligned(docs, path_a, path_b, key, text), "aligned")
    counts = held_pairs(rows).join(common.written(pair_counts(rows), "counts"), ["a", "b"]).select("batch", "place", "count", "best")
    texts = rows.filter("a IS NULL").select(F.col("batch").alias("own"), "k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    scored = texts.groupBy("own").cogroup(counts.groupBy("batch")).applyInArrow(
        _scored, "k long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return scored.withColumnRenamed("k", key)


def groups(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per group of tokens that cover the same bytes: key, group, start and end byte, ids of A and B.

    Bytes count from the text's first, so the space before it stands at -1.
    """
    schema = pa.schema([("k", pa.int64()), ("group", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                        ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])

    def make(batch: pa.RecordBatch) -> dict:
        both = pair(path_a, path_b)
        found = tokenised(batch.column(1), both)
        known = both.aligned(found.keys)
        out: dict[str, list] = {n: [] for n in schema.names}
        for row, key_ in enumerate(batch.column(0).to_pylist()):
            at, number = -1, 0
            for window in found.windows[found.first_window[row]:found.first_window[row + 1]].tolist():
                for one in known[window][0].split(";"):
                    a, b = ([int(x) for x in side.split(",")] for side in one.split("|"))
                    size = int(both.bytes_a.lengths[a].sum())
                    for name, value in zip(schema.names, (key_, number, at, at + size, a, b), strict=True):
                        out[name].append(value)
                    at, number = at + size, number + 1
        return out

    return docs.select(F.col(key).cast("long").alias("k"), common.text_of(text).alias("t")).mapInArrow(
        lambda rows: common.batches(rows, schema, make),
        "k long, group int, start long, end long, a array<int>, b array<int>").withColumnRenamed("k", key)
