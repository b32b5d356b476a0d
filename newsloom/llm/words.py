"""Words of whole texts as digests, computed over the bytes of an Arrow column.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Arrow's dictionary tells the
words of a batch apart by their bytes; each distinct one gets 128 bits of a cryptographic digest
(BLAKE2s), so that all tasks agree and no choice of words makes two of them meet.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]

_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".!?,;:\"'()[]{}*_-"]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def _bytes(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
    if fold:
        values[65:91] = values[97:123]
    return values


@dataclass
class Words:
    data: np.ndarray      # all bytes
    offsets: np.ndarray   # byte offset of each text, and the end
    starts: np.ndarray    # byte where each word starts
    ends: np.ndarray      # byte after each word
    first: np.ndarray     # number of words before each text, and in all
    hashes: np.ndarray    # first 64 bits of each word's digest
    others: np.ndarray    # the other 64 bits

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def distinct_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each span's bytes among the distinct ones, those) of spans that lie end to end."""
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = spans.dictionary_encode()
    _, places, content = coded.dictionary.buffers()
    at, raw = np.frombuffer(places, np.int64)[: len(coded.dictionary) + 1].tolist(), content.to_pybytes() if content else b""
    return coded.indices.to_numpy(zero_copy_only=False), [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def digests(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the digest of each span of `data`; the spans lie end to end."""
    if not len(ends):
        return np.zeros(0, U), np.zeros(0, U)
    codes, spans = distinct_spans(data, ends)
    digest = hashlib.blake2s
    halves = np.frombuffer(b"".join([digest(x).digest() for x in spans]), "<u8").reshape(-1, 4)
    return halves[codes, 0], halves[codes, 1]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string column; a null text is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset: column.offset + len(column) + 1].copy()
    low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    data = np.frombuffer(raw[2], np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    return data, offsets - low


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start and end byte of each word of all texts, which bytes lie in words)."""
    space = _SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    inside = ~space
    before = np.concatenate(([True], space[:-1])) if len(data) else space
    after = np.concatenate((space[1:], [True])) if len(data) else space
    starts = np.flatnonzero(inside & (before | border[:-1]))
    ends = np.flatnonzero(inside & (after | border[1:])) + 1
    return starts, ends, inside


def words(column: pa.Array, fold: bool = False, trim: bool = False) -> Words:
    """Words of every text of a string column; `fold` takes A-Z as a-z. A null text has none.

    With `trim`, digests are those of the words without up to three marks at each end.
    """
    data, offsets = flat_bytes(column)
    starts, ends, inside = word_spans(data, offsets)
    first = np.searchsorted(starts, offsets)
    low, high = _trimmed(data, starts, ends, inside) if trim else (starts, ends)
    packed = data[inside]
    hashes, others = digests(_LOWER[packed] if fold else packed, np.cumsum(high - low))
    return Words(data, offsets, starts, ends, first, hashes, others)


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without up to three marks at each end, of which one byte stays; `inside` loses the marks."""
    low, high = starts.copy(), ends.copy()
    for _ in range(3 if len(low) else 0):
        gone = np.flatnonzero((low < high - 1) & _MARKS[data[low]])
        inside[low[gone]] = False
        low[gone] += 1
        gone = np.flatnonzero((low < high - 1) & _MARKS[data[high - 1]])
        inside[high[gone] - 1] = False
        high[gone] -= 1
    return low, high


def prefix_hashes(found: Words, size: int, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word longer than `size` bytes, hash of its first `size` bytes)."""
    at = np.flatnonzero(found.ends - found.starts > size)
    out = np.full(len(at), U(size))
    for j in range(size):
        out = out * _BASE + _bytes(fold)[found.data[found.starts[at] + j]]
    return at, mix(out)


def sequence_hash(hashes: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of the `size` consecutive word digests from each place `at` (64 bits, order matters)."""
    out = np.full(len(at), U(seed))
    for k in range(size):
        out = mix(out * _BASE ^ hashes[at + k])
    return out
