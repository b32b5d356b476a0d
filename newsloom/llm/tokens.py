"""Token ids of whole texts by the tokenizers library, with a bounded cache of pieces.

Both pre-tokenizers cut a text by one pattern into pieces whose ids do not depend on what stands
around them. Each distinct piece goes to the library's model once per worker and cache filling; texts for
which the cut is not certain (added tokens, scripts beyond Latin) go to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from newsloom.llm.words import distinct_spans, flat_bytes

CACHE_PIECES = 250_000
_STEP = 1 << 16
_LONG = 1 << 20

# The patterns of the two pre-tokenizers, for texts whose only letters are Latin and
# whose only numerals are 0-9.
_BYTE_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
_WORD_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_OTHER_TEXT = re.compile("[^\t-\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")

_NOT_PLAIN = "['\\x00-\\x08\\x0e-\\x1f\\x7f-\\x{bf}\\x{d7}\\x{f7}\\x{250}-\\x{10ffff}]"
BATCH = 1024
# The letter that stands for each byte in both vocabularies.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: chr(b) for b in _SEEN} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SEEN)))}
# The one letter here whose lower case is two characters ends in this one, where the library cuts.
_NOT_ONE_LOWER = "\u0307".encode().decode("latin-1").translate(_ALPHABET)
_BLANK, _LETTER, _DIGIT, _MARK = range(4)
_KINDS = np.full(256, _MARK, np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = _BLANK
_KINDS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = _LETTER
_KINDS[ord("0"):ord("9") + 1] = _DIGIT


def file_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


class Encoder:
    """`encode(text)` equals the library's ids for it, without special tokens around it.

    Without `specials`, the strings of special tokens inside a text are plain text.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES, specials: bool = True):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not specials
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        kind = settings["pre_tokenizer"]
        self.by_byte = kind["type"] == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"] and not settings["normalizer"]
        split = kind.get("pretokenizers", [{}])[0]
        self.by_word = split.get("type") == "Split" and split["behavior"] == "Removed" and r"\s" in split["pattern"]["Regex"]
        self.added = [t["content"] for t in settings["added_tokens"]] if specials else []
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.model = self.library.model
        self.limit = cache_pieces
        self._empty()

    def _empty(self) -> None:
        self.place: dict[bytes, int] = {}
        self.starts = np.zeros(1024, np.int64)
        self.lengths = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.again = np.zeros(1024, bool)
        self.used = 0

    def _make_room(self) -> None:
        """Where the cache is full, forget the pieces that were met once; all, if they leave little room."""
        if len(self.place) <= self.limit:
            return
        kept = np.flatnonzero(self.again[:len(self.place)])
        pieces = [p for p, again in zip(self.place, self.again.tolist(), strict=False) if again]
        ids, lengths = self._gathered(kept), self.lengths[kept]
        self._empty()
        if 2 * len(kept) < self.limit:
            self._keep(pieces, ids, lengths)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, pieces: list[bytes]) -> None:
        """Ids of new pieces, each different: a piece is one word of the library's model, byte by byte in its alphabet."""
        if self.by_word:
            lower = b"\n".join(pieces).decode().lower().encode()
            words = lower.decode("latin-1").translate(_ALPHABET).split(_ALPHABET[0x0A])
        else:
            spelt = b"".join(pieces).decode("latin-1").translate(_ALPHABET)
            words = [spelt[a:b] for a, b in pairwise(accumulate(map(len, pieces), initial=0))]
        found: list[int] = []
        ends = []
        for piece, word in zip(pieces, words, strict=True):
            if self.by_word and _NOT_ONE_LOWER in word:
                found += self._whole(piece.decode()).tolist()
            else:
                found += [t.id for t in self.model.tokenize(word)]
            ends.append(len(found))
        self._keep(pieces, np.array(found, np.uint32), np.diff(ends, prepend=0))

    def _keep(self, pieces: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember new pieces, of which each has so many of the ids."""
        at, n = len(self.place), len(pieces)
        while at + n > len(self.starts):
            self.starts, self.lengths, self.again = (np.resize(x, 2 * len(x)) for x in (self.starts, self.lengths, self.again))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used:self.used + len(ids)] = ids
        self.starts[at:at + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[at:at + n] = lengths
        self.again[at:at + n] = False
        self.used += len(ids)
        self.place.update(zip(pieces, range(at, at + n), strict=True))

    def _known(self, pieces: list[bytes]) -> np.ndarray:
        """Place of each piece in the cache; those not there are learned."""
        at = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if len(missing):
            fresh = {pieces[i]: None for i in missing.tolist()}
            first = len(self.place)
            self._learn(list(fresh))
            at[missing] = np.arange(first, first + len(missing)) if len(fresh) == len(missing) else [
                self.place[pieces[i]] for i in missing.tolist()]
        return at

    def _slices(self, text: str) -> Iterator[list[str]]:
        pattern = _BYTE_PIECE if self.by_byte else _WORD_PIECE
        text = text if self.by_byte else text.lower()
        if len(text) < _LONG:
            yield pattern.findall(text)
            return
        found = pattern.finditer(text)
        while some := [m.group() for m in islice(found, _STEP)]:
            yield some

    def _places(self, text: str) -> Iterator[np.ndarray]:
        for pieces in self._slices(text):
            self._make_room()
            yield self._known([p.encode() for p in pieces])

    def _cut(self, text: str) -> bool:
        if not (self.by_byte or self.by_word) or any(t in text for t in self.added):
            return False
        return not _OTHER_TEXT.search(text)

    def _spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of all pieces of plain texts, in bytes."""
        kind = _KINDS[data]
        begin = np.zeros(len(data) + 1, bool)
        begin[1:-1] = kind[1:] != kind[:-1]
        begin[offsets] = True
        begin = begin[:-1]
        if self.by_word:
            begin |= kind == _DIGIT
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        blank = kind[starts] == _BLANK
        if self.by_word:
            return starts[~blank], ends[~blank]
        # The last of several blanks before something parts from the others; a space joins what follows.
        last = np.zeros(len(data) + 1, bool)
        last[offsets] = True
        before = blank & ~last[ends]
        space = np.zeros(len(starts), bool)
        space[before] = data[ends[before] - 1] == 0x20
        follower = np.append(False, space[:-1])
        starts = starts - follower
        ends = ends - space
        long = before & ~space & (ends - starts > 1)
        cut = ends[long] - 1
        ends[long] = cut
        full = ends > starts
        starts, ends = np.concatenate((starts[full], cut)), np.concatenate((ends[full], cut + 1))
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place of each piece of all texts in the cache, number of pieces before each text) of plain texts."""
        data, offsets = flat_bytes(texts)
        starts, ends = self._spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        # All that lies between pieces is blank.
        packed = data[_KINDS[data] != _BLANK] if self.by_word else data
        codes, spans = distinct_spans(packed, np.cumsum(ends - starts))
        self._make_room()
        return self._known(spans)[codes], np.searchsorted(starts, offsets)

    def _gathered(self, at: np.ndarray) -> np.ndarray:
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        index = np.repeat(self.starts[at] - (ends - lengths), lengths)
        return self.flat[index + np.arange(len(index))]

    def _split(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(numbers of the plain texts, numbers of the others, texts)."""
        texts = pc.fill_null(column, "").cast(pa.large_string())
        plain = pc.and_(pc.invert(pc.match_substring_regex(texts, _NOT_PLAIN)), pc.less(pc.binary_length(texts), _LONG))
        for mark in self.added:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, mark)))
        good = plain.to_numpy(zero_copy_only=False).astype(bool) & (self.by_byte or self.by_word)
        return np.flatnonzero(good), np.flatnonzero(~good), texts

    def encode_all(self, column: pa.Array) -> list[np.ndarray]:
        """`encode` of every text of a column; a null text is empty."""
        good, rest, texts = self._split(column)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for some in (good[i:i + BATCH] for i in range(0, len(good), BATCH)):
            at, first = self._plain(texts.take(some))
            ids = self._gathered(at)
            cut = np.append(0, np.cumsum(self.lengths[at]))[first]
            for i, a, b in zip(some.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                out[i] = ids[a:b]
        for i in rest.tolist():
            out[i] = self.encode(texts[i].as_py())
        return out

    def count_all(self, column: pa.Array) -> np.ndarray:
        """Number of ids of every text of a column."""
        good, rest, texts = self._split(column)
        out = np.zeros(len(texts), np.int64)
        for some in (good[i:i + BATCH] for i in range(0, len(good), BATCH)):
            at, first = self._plain(texts.take(some))
            out[some] = np.diff(np.append(0, np.cumsum(self.lengths[at]))[first])
        for i in rest.tolist():
            out[i] = self.count(texts[i].as_py())
        return out

    def encode(self, text: str) -> np.ndarray:
        if not self._cut(text):
            return self._whole(text)
        parts = [self._gathered(at) for at in self._places(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def count(self, text: str) -> int:
        if not self._cut(text):
            return len(self._whole(text))
        return sum(int(self.lengths[at].sum()) for at in self._places(text))


@lru_cache(maxsize=2)
def encoder(path: str, specials: bool = True) -> Encoder:
    """One encoder per worker and vocabulary file."""
    return Encoder(path, specials=specials)
