"""The SVD of the benchmark's passages is made of sums over partitions."""

from __future__ import annotations

import numpy as np

from newsloom.llm import decontaminate


def test_products_over_partitions_are_those_of_a_whole_matrix(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "_ROWS", 7)
    draw = np.random.default_rng(3)
    vocabulary = np.sort(draw.choice(1 << 62, 90, replace=False).astype(np.uint64)) * np.uint64(3)
    idf = draw.uniform(0.1, 9, 90)
    chosen = [draw.integers(0, 90, n) for n in (*range(1, 33), 3, 3)]
    chosen += [chosen[5], chosen[5][::-1], np.arange(90)]  # copies are dependent rows
    matrix = np.zeros((len(chosen), 90))
    for row, at in zip(matrix, chosen, strict=True):
        np.add.at(row, at, idf[at])
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    asked = []
    held = decontaminate._unit_rows
    monkeypatch.setattr(decontaminate, "_unit_rows", lambda *a: asked.append(1) or held(*a))
    passages = spark.createDataFrame([(p, bytearray(vocabulary[at].tobytes())) for p, at in enumerate(chosen)], "p int, words binary")
    near, mass = decontaminate.randomised_svd(passages, vocabulary, idf)
    right = np.linalg.svd(unit, full_matrices=False)
    basis = right[2][right[1] > 1e-6 * right[1][0]].T
    assert np.allclose(near, basis @ (unit @ basis).T, atol=1e-5)
    assert np.allclose(mass, [np.sqrt((idf[at] ** 2).sum()) for at in chosen])
    # The driver weighs no passage itself.
    assert not asked
