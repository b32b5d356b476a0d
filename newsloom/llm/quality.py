"""Quality rules with compression bands.

Counts of words, symbols, repeated lines and repeated windows of eight words give the base rules.
The verdict on what they pass is by compression: a text that zstandard shrinks far better than
prose of its length repeats itself, one that it hardly shrinks is noise. Both the whole text and
fixed chunks are held against a band of ratios that depends on the length compressed, since
short texts shrink less.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import common
from newsloom.llm.words import distinct_spans, flat_bytes, word_spans

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules, and bands (least bytes, lowest and highest ratio of bytes before to after).

    A length takes the last band that starts at or below it; below the first band no ratio is
    judged. A text goes if its own ratio is outside its band, or if chunks outside theirs hold more
    than `bad_share` of its bytes. A last piece shorter than half a chunk joins the chunk before it.
    """

    least_words: int = 20
    window: int = 8
    repeat_percent: int = 30
    level: int = 3
    chunk: int = 2048
    bad_share: float = 0.3
    bands: tuple[tuple[int, float, float], ...] = (
        (128, 0.90, 2.6), (256, 1.05, 2.8), (512, 1.20, 3.0), (1024, 1.35, 3.4), (4096, 1.45, 4.0),
        (16384, 1.50, 5.0), (65536, 1.50, 6.0), (1 << 20, 1.50, 8.0))

    def band(self, size: int) -> tuple[float, float] | None:
        found = None
        for least, low, high in self.bands:
            if size >= least:
                found = (low, high)
        return found


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair, equal if and only if both parts are."""
    return pd.factorize(left.astype(np.int64) * (int(right.max()) + 1) + right)[0] if len(left) else left


def repeated_windows(codes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a window of `size` words (a power of two) found twice or more in its text.

    Windows are numbered by doubling: pairs of words, then pairs of pairs, so equal numbers are
    equal words and no hash decides.
    """
    n, named, width = len(codes), codes, 1
    while width < size:
        named = _pairs(named[:-width], named[width:]) if len(named) > width else named[:0]
        width *= 2
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inner = np.flatnonzero(first[text[:len(named)] + 1] - np.arange(len(named)) >= size)
    edge = np.zeros(n + 1, np.int64)
    if len(inner):
        twice = pd.Series(_pairs(text[inner], named[inner])).duplicated(keep=False).to_numpy()
        np.add.at(edge, inner[twice], 1)
        np.add.at(edge, inner[twice] + size, -1)
    return np.cumsum(edge)[:-1] > 0


def repeated_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of lines of each text that hold a word and equal an earlier line of it."""
    ends_at = np.flatnonzero(data == 10)
    low, high = np.sort(np.append(offsets[:-1], ends_at + 1)), np.sort(np.append(ends_at, offsets[1:]))
    text = np.searchsorted(offsets[1:-1], low, "right")
    # Where empty texts or lines share a place with a line that has words, that one stands last there.
    codes = distinct_spans(data, np.column_stack((low, high)).ravel()[1:])[0][::2] if len(low) else low
    worded = np.searchsorted(starts, high) > np.searchsorted(starts, low)
    again = pd.Series(_pairs(text[worded], codes[worded])).duplicated().to_numpy(bool)
    return np.bincount(text[worded][again], minlength=len(offsets) - 1)


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of marked bytes in each text."""
    out, full = np.zeros(len(offsets) - 1, np.int64), np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(mask, offsets[:-1][full], dtype=np.int64)
    return out


def compression(data: bytes, rules: Rules, press: zstandard.ZstdCompressor) -> tuple[float | None, float, bool]:
    """(ratio of the whole, share of bytes in chunks outside their band, verdict)."""
    size = len(data)
    if not size:
        return None, 0.0, True

    def outside(piece: bytes) -> tuple[float, bool]:
        ratio, band = len(piece) / len(press.compress(piece)), rules.band(len(piece))
        return ratio, band is not None and not band[0] <= ratio <= band[1]

    ratio, bad = outside(data)
    cuts = list(range(0, max(size - rules.chunk // 2, 1), rules.chunk)) + [size]
    wrong = 0
    if len(cuts) > 2:
        wrong = sum(high - low for low, high in zip(cuts[:-1], cuts[1:], strict=True) if outside(data[low:high])[1])
    return ratio, wrong / size, not bad and wrong <= rules.bad_share * size


def counted(column: pa.Array, rules: Rules) -> dict[str, np.ndarray | list]:
    """All counts and verdicts of the texts of a column; a null text is empty."""
    data, offsets = flat_bytes(column)
    starts, ends, inside = word_spans(data, offsets)
    first = np.searchsorted(starts, offsets)
    codes = distinct_spans(data[inside], np.cumsum(ends - starts))[0] if len(starts) else np.zeros(0, np.int64)
    covered = np.append(0, np.cumsum(repeated_windows(codes, first, rules.window)))
    words, repeated = np.diff(first), np.diff(covered[first])
    failed = (words < rules.least_words) | (100 * repeated > rules.repeat_percent * words)
    press = zstandard.ZstdCompressor(level=rules.level)
    raw = data.tobytes()
    pressed = [compression(raw[a:b], rules, press) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return {"n_words": words, "word_chars": _sums(inside & ((data & 0xC0) != 0x80), offsets),
            "n_symbols": _sums(_SYMBOL[data], offsets), "n_dup_lines": repeated_lines(data, offsets, starts),
            "n_repeat_words": repeated, "base_failed": failed,
            "kept": ~failed & np.array([p[2] for p in pressed], bool),
            "ratio": pa.array([p[0] for p in pressed], pa.float64()),
            "bad_share": np.array([p[1] for p in pressed], float)}


RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, ratio double, bad_share double")
_RESULT = [*((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
           ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("bad_share", pa.float64())]


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per row of `docs`: key, counts, base_failed, kept, ratio, bad_share.

    A null or empty text has no words and fails the base rules, its ratio is null. Rows that
    repeat, and rows without key, come out as often as they come in. Other columns are not read.
    """
    schema = pa.schema([("k", pa.int64()), *_RESULT])

    def make(batch: pa.RecordBatch) -> dict:
        return {"k": batch.column(0), **counted(batch.column(1), rules)}

    return docs.select(F.col(key).cast("long").alias("k"), common.text_of(text).alias("t")).mapInArrow(
        lambda rows: common.batches(rows, schema, make), f"k long, {RESULT}").withColumnRenamed("k", key)


def drop_poor(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Rows of `docs` that the rules keep, in place, with all their columns."""
    schema = docs.schema
    at = schema.fieldNames().index(text)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            kept = counted(batch.column(at).cast(pa.large_string()), rules)["kept"]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, schema)
