"""The cache of pieces: what is met again stays, and ids are the library's."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pytest

from newsloom.llm.tokens import Encoder

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.mark.parametrize("name", NAMES)
def test_pieces_met_again_are_learned_once(name):
    made, learned = Encoder(public_tokenizers.path(name), cache_pieces=60), []
    learn = made._learn
    made._learn = lambda pieces: (learned.extend(pieces), learn(pieces))[1]
    for i in range(20):
        fresh = " ".join("w" + chr(97 + i) + chr(97 + j) for j in range(20))
        text = f"{fresh} common words stay here"
        assert made.encode_all(pa.array([text]))[0].tolist() == made.library.encode(text, add_special_tokens=False).ids
        assert len(made.place) <= made.limit + 25
    assert sum(p.strip() == b"common" for p in learned) == 1


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("text", ["", "İstanbul İİ x", "ẞ ß ŉ ǰ Ǆ ǅ", "it's we'll", " \n\n two  blanks\t\tx ", "ÀÉ 9é9 12", "日本 語",
                                  "a.b,c!! #x __y", "<|endoftext|> z", "naïve ’quoted’ —dash"])
def test_ids_are_the_librarys(name, text):
    made = Encoder(public_tokenizers.path(name))
    wanted = made.library.encode(text, add_special_tokens=False).ids
    assert made.encode(text).tolist() == wanted
    assert [x.tolist() for x in made.encode_all(pa.array([text, None, text]))] == [wanted, [], wanted]
