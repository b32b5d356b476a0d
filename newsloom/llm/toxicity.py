"""Toxic documents by multiple-instance learning.

A document is a bag of sentences. A sentence gets a probability from its words; the document's
is the noisy-or, 1 - prod(1 - p), so one offending sentence suffices and clean ones do not dilute
it. Only documents carry labels: the gradient of the document's loss reaches each sentence in
proportion to what it contributes, which also locates the offending ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import common
from newsloom.llm.words import Words, prefix_hashes, words

# Bounds of the labelled sample that the classifier is fitted on: documents per label and the
# length of a text that may be in it. Scoring has no such bounds.
SAMPLE_PER_LABEL = 2_000
SAMPLE_CHARS = 8_000


@dataclass(frozen=True)
class Training:
    bits: int = 18        # features are hashed into 2**bits weights
    prefixes: tuple[int, ...] = (4, 5)  # bytes of word beginnings
    epochs: int = 100
    rate: float = 1.0
    least_documents: int = 5  # of the sample that a feature must be in
    decay: float = 1e-4   # pull of weights towards zero
    prior: float = -5.0   # log-odds of a sentence without known words
    per_label: int = SAMPLE_PER_LABEL
    chars: int = SAMPLE_CHARS


def sentences(found: Words) -> np.ndarray:
    """Number of the sentence of each word, counted over all texts; ends at . ! ? and line ends."""
    n = len(found.starts)
    if not n:
        return np.zeros(0, np.int64)
    last = found.data[found.ends - 1]
    ends = (last == ord(".")) | (last == ord("!")) | (last == ord("?"))
    lines = np.concatenate(([0], np.cumsum(found.data == ord("\n"))))
    ends[:-1] |= lines[found.starts[1:]] > lines[found.ends[:-1]]
    ends[found.first[1:][found.first[1:] > 0] - 1] = True
    return np.cumsum(ends) - ends


def features(column: pa.Array, how: Training) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight index of each feature, its sentence, number of the first sentence of each text and of all).

    Features are the words and the beginnings of longer ones, which inflected forms share.
    """
    found = words(column, fold=True, trim=True)
    sentence = sentences(found)
    parts, owners = [found.hashes], [np.arange(len(sentence))]
    for size in how.prefixes:
        at, hashes = prefix_hashes(found, size, fold=True)
        parts.append(hashes)
        owners.append(at)
    index = (np.concatenate(parts) >> np.uint64(64 - how.bits)).astype(np.int64)
    total = int(sentence[-1]) + 1 if len(sentence) else 0
    per_text = np.append(sentence, total)[found.first]
    return index, sentence[np.concatenate(owners)], per_text


def fit(texts: pa.Array, labels: np.ndarray, how: Training) -> np.ndarray:
    """Weights: one per hashed word, and the bias last."""
    index, sentence, per_text = features(texts, how)
    count, n = int(per_text[-1]), len(labels)
    document = np.repeat(np.arange(n), np.diff(per_text))
    # Words of few documents would only learn these documents by heart.
    seen = np.bincount(np.unique(document[sentence] * (1 << how.bits) + index) & ((1 << how.bits) - 1), minlength=1 << how.bits)
    usual = seen[index] >= how.least_documents
    sentence, index = sentence[usual], index[usual]
    weights, second = np.zeros(1 << how.bits), np.zeros(1 << how.bits)
    bias = how.prior
    balance = np.where(labels == 1, n / max(2 * labels.sum(), 1), n / max(2 * (n - labels.sum()), 1))
    for _ in range(how.epochs):
        z = np.bincount(sentence, weights=weights[index], minlength=count) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.clip(np.bincount(document, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n), -50, 0))
        whole = np.clip(1 - none, 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: clean documents push it down by p, toxic ones up by its share.
        slope = np.where(labels == 1, -none / whole, 1.0) * balance
        gradient = np.bincount(index, weights=(slope[document] * p)[sentence], minlength=1 << how.bits)
        gradient += how.decay * n * weights
        second += gradient ** 2
        weights -= how.rate * gradient / np.sqrt(second + 1e-8)
    return np.append(weights, bias)


def score(texts: pa.Array, weights: np.ndarray, how: Training) -> tuple[np.ndarray, list[np.ndarray]]:
    """(document scores, sentence scores of each text); a text without sentences scores 0."""
    index, sentence, per_text = features(texts, how)
    z = np.bincount(sentence, weights=weights[index], minlength=int(per_text[-1])) + weights[-1]
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    # A sentence without known words says nothing; long texts are not worse for having more of them.
    base = np.log1p(-1 / (1 + np.exp(-weights[-1])))
    total = np.concatenate(([0], np.cumsum(np.minimum(np.log1p(-np.minimum(p, 1 - 1e-12)) - base, 0))))
    whole = 1 - np.exp(total[per_text[1:]] - total[per_text[:-1]])
    return np.clip(whole, 0, 1), [p[a:b] for a, b in zip(per_text[:-1], per_text[1:], strict=True)]


def held_out(key: str = "doc_id"):
    """True for the fifth of all rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, how: Training = Training(), key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """One row with the weights, fitted in one task on a bounded sample of rows not held out.

    The sample takes, per label, the documents of least key hash among those of bounded length.
    """
    known = (labels.filter("toxic IN (0, 1)").filter(~held_out(key)).groupBy(key)
             .agg(F.max("toxic").cast("long").alias("toxic")))
    texts = docs.select(key, common.text_of(text).alias("t"))
    short = texts.filter(F.char_length("t") <= how.chars).select(key)
    parts = [known.filter(F.col("toxic") == label).join(short, key).select(
        key, "toxic", F.xxhash64(key).alias("h")).distinct().orderBy("h", key).limit(how.per_label) for label in (0, 1)]
    # At most twice `per_label` keys; only their texts move.
    picked = common.written(parts[0].union(parts[1]), "sample")
    sampled = texts.join(F.broadcast(picked), key).filter(F.char_length("t") <= how.chars).select("toxic", "t", "h")

    def one(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["h", "toxic", "t"])
        weights = fit(pa.array(sample["t"]), sample["toxic"].to_numpy(), how)
        return pd.DataFrame({"weights": [weights.astype("<f8").tobytes()]})

    return sampled.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(one, "weights binary")


def weights_of(model: DataFrame, how: Training = Training()) -> np.ndarray:
    """The fitted weights (a fixed number of them); without labelled rows every word weighs nothing."""
    row = model.first()
    if row is None:
        return np.append(np.zeros(1 << how.bits), how.prior)
    return np.frombuffer(row["weights"], "<f8")


def scores(docs: DataFrame, weights: np.ndarray, how: Training = Training(), key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """One row per row: key, score, predicted, worst_sentence (its number from 0, -1: none), worst_score.

    A null or blank text has no sentences: score 0. Keys are carried as they are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    schema = pa.schema([("k", pa.int64()), ("score", pa.float64()), ("worst_sentence", pa.int64()),
                        ("worst_score", pa.float64())])

    def make(batch: pa.RecordBatch) -> dict:
        whole, parts = score(batch.column(1), sent.value, how)
        return {"k": batch.column(0), "score": whole,
                "worst_sentence": np.array([int(p.argmax()) if len(p) else -1 for p in parts], np.int64),
                "worst_score": np.array([float(p.max()) if len(p) else 0.0 for p in parts])}

    out = docs.select(F.col(key).cast("long"), common.text_of(text)).mapInArrow(
        lambda rows: common.batches(rows, schema, make), "k long, score double, worst_sentence long, worst_score double")
    return out.select(F.col("k").alias(key), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
                      "worst_sentence", "worst_score")


def toxic_scores(docs: DataFrame, labels: DataFrame, how: Training = Training(), key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per row: key, held_out, score, predicted, worst_sentence, worst_score."""
    found = scores(docs, weights_of(train(docs, labels, how, key, text), how), how, key, text)
    return found.select(key, held_out(key).alias("held_out"), "score", "predicted", "worst_sentence", "worst_score")


def drop_toxic(docs: DataFrame, labels: DataFrame, how: Training = Training(), key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """Rows of `docs` not predicted toxic, with all their columns; each row is judged by itself, in place."""
    sent = docs.sparkSession.sparkContext.broadcast(weights_of(train(docs, labels, how, key, text), how))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            whole, _ = score(batch.column(batch.num_columns - 1), sent.value, how)
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(whole < 0.5))

    return docs.select(*docs.columns, common.text_of(text)).mapInArrow(run, docs.schema)
