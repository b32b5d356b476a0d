"""The table of a block gives the cosines of the full space in one sum over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from newsloom.llm import decontaminate
from newsloom.llm.words import words


def test_a_block_holds_the_product_of_each_word_with_each_passage(spark):
    items = [(i, " ".join(f"w{(7 * i + j * (i + 1)) % 61}" for j in range(30 + 5 * i))) for i in range(6)]
    docs = spark.createDataFrame([(i, t + " tail") for i, t in items], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    (block,) = decontaminate.blocks(docs, benchmark, decontaminate.Retrieval(), "text")
    assert block.near.shape == (len(block.vocabulary), len(block.item_of))
    own = np.zeros((len(block.item_of), len(block.vocabulary)))
    spans = [s for _, w, _ in block.items for s in [(w, a, b) for a, b in decontaminate._spans(len(w), 16)]]
    for row, (w, a, b) in zip(own, spans, strict=True):
        at = np.searchsorted(block.vocabulary, np.array(w, np.uint64)[a:b])
        np.add.at(row, at, block.idf[at])
    unit = own / np.linalg.norm(own, axis=1)[:, None]
    assert np.allclose(own @ block.near, own @ unit.T, atol=1e-3)
    found = words(pa.array([items[3][1]]), fold=True, trim=True)
    assert 3 in {block.items[n][0] for _, n, _, _ in decontaminate.candidates(found, block, decontaminate.Retrieval())}
