"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A sketch of t coordinates is filled in rounds. In round i < t every shingle is thrown into one
of t bins with a value in [i, i+1); a coordinate is the least value seen in its bin. In round
t + j all shingles go to bin j, so every coordinate fills. Rounds stop once all are full, so a
set of some t log t shingles needs one round. Coordinates of two sets agree with probability
close to their Jaccard similarity and concentrate like independent ones.

Sketches are cut into bands. Sets that share a band are candidates. Instead of all pairs of a
bucket, each set is first compared with one hub, the member that shares most bands with others.
What stays apart in a bucket is settled by an exact join on rarest shingles (a pair that reaches
the threshold shares a shingle among the rarest of both), between different components only.
All links are confirmed on full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm import common
from newsloom.llm.words import Words, mix, sequence_hash, words

U = np.uint64


@dataclass(frozen=True)
class Settings:
    """`shingle` words a shingle, Jaccard similarity >= `percent`/100, `bands` of `rows` coordinates.

    With 24 bands of 5, sets at 0.85 share no band with probability 8e-7, at 0.8 with 7e-5 (use
    36 bands there: 5e-7).
    """

    shingle: int = 3
    percent: int = 85
    bands: int = 24
    rows: int = 5
    seed: int = 0x5EED

    @property
    def size(self) -> int:
        return self.bands * self.rows


def shingle_sets(found: Words, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle are one shingle."""
    h, k = found.hashes, shingle
    rolled = sequence_hash(h, np.arange(max(len(h) - k + 1, 0)), k, k)
    for low, high in zip(found.first[:-1], found.first[1:], strict=True):
        if high - low >= k:
            yield np.unique(rolled[low:high - k + 1])
        elif high > low:
            yield sequence_hash(h, np.array([low]), high - low, high - low)
        else:
            yield np.zeros(0, U)


def sketch(values: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of hashes: `size` uint64 coordinates."""
    out = np.full(size, np.iinfo(np.uint64).max, U)
    for i in range(2 * size):
        drawn = mix(values ^ U((seed + i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        low = (drawn >> U(12)) | (U(i) << U(52))  # value in [i, i+1) as a fixed-point number
        if i < size:
            np.minimum.at(out, ((drawn & U(0xFFF)) * U(size) >> U(12)).astype(np.int64), low)
        else:
            out[i - size] = min(out[i - size], low.min())
        if not (out == np.iinfo(np.uint64).max).any():
            break
    return out


def band_keys(values: np.ndarray, settings: Settings) -> np.ndarray:
    coordinates = sketch(values, settings.size, settings.seed).reshape(settings.bands, settings.rows)
    keys = np.arange(1, settings.bands + 1, dtype=U)
    for j in range(settings.rows):
        keys = mix(keys * U(0x9E3779B97F4A7C15) + coordinates[:, j])
    return keys.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def sketches(docs: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """(key, n_shingles, digest of the set, band keys) per row."""
    schema = pa.schema([("k", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
                        ("bands", pa.list_(pa.int64()))])

    def make(batch: pa.RecordBatch) -> dict:
        sets = list(shingle_sets(words(batch.column(1), fold=True), settings.shingle))
        return {"k": batch.column(0), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                "bands": _lists([band_keys(s, settings) if len(s) else np.zeros(0, U) for s in sets])}

    return docs.select(F.col(key).cast("long"), common.text_of(text)).mapInArrow(
        lambda rows: common.batches(rows, schema, make), "k long, n_shingles long, digest binary, bands array<long>")


def full_sets(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(k, sorted shingle hashes) per row."""
    schema = pa.schema([("k", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def make(batch: pa.RecordBatch) -> dict:
        return {"k": batch.column(0),
                "shingles": _lists(list(shingle_sets(words(batch.column(1), fold=True), shingle)))}

    return docs.select(F.col(key).cast("long"), common.text_of(text)).mapInArrow(
        lambda rows: common.batches(rows, schema, make), "k long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def make(batch: pa.RecordBatch) -> dict:
        left, right = batch.column(2), batch.column(3)
        lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
        lv, rv = left.values.to_numpy().view(U), right.values.to_numpy().view(U)
        keep = []
        for i in range(batch.num_rows):
            x, y = lv[lo[i]:lo[i + 1]], rv[ro[i]:ro[i + 1]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        return {"a": batch.column(0).filter(mask), "b": batch.column(1).filter(mask)}

    left = sets.select(F.col("k").alias("b"), F.col("shingles").alias("y"))
    right = sets.select(F.col("k").alias("a"), F.col("shingles").alias("x"))
    full = pairs.select("a", "b").join(left, "b").join(right, "a").select("a", "b", "x", "y")
    return full.mapInArrow(lambda rows: common.batches(rows, schema, make), "a long, b long")


def hub_pairs(members: DataFrame) -> DataFrame:
    """(a = hub, b) for each set: of the buckets it is in, the hub with the most company."""
    company = members.groupBy("k").agg(F.sum("size").alias("company"))
    hubs = members.join(company, "k").groupBy("key").agg(
        F.max(F.struct("company", (-F.col("k")).alias("hub"))).alias("hub"))
    return (members.join(hubs, "key").groupBy("k").agg(F.max("hub").alias("hub"))
            .select((-F.col("hub.hub")).alias("a"), F.col("k").alias("b")).filter("a <> b"))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, label) of the members of buckets that hold more than one component."""
    named = members.join(labels.withColumnRenamed("node", "k"), "k", "left").withColumn(
        "label", F.coalesce("label", "k"))
    apart = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return named.join(apart, "key", "left_semi").select("k", "label").distinct()


def rare_shingle_pairs(sets: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components that may still reach the similarity.

    Shingles are ordered by frequency among these sets. A pair at the threshold shares one among
    the first |set| - ceil(threshold * |set|) + 1 of both; sizes and positions bound the overlap.
    Per shingle the largest component is not compared with itself.
    """
    rows = sets.join(mixed, "k").select("k", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    shared = rows.groupBy("s").agg(F.count("*").alias("times")).filter("times > 1")
    common_rows = rows.join(shared, "s")
    order = W.partitionBy("k").orderBy("times", "s")
    whole = W.partitionBy("k")
    ranked = common_rows.withColumns({"rank": F.row_number().over(order), "in_common": F.count("*").over(whole)})
    prefix = (ranked.withColumn("pos", F.col("n") - F.col("in_common") + F.col("rank") - 1)
              .filter(F.col("pos") < F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
              .select("s", "k", "label", "n", "pos"))
    prefix = common.written(prefix, "prefix")
    largest = (prefix.groupBy("s", "label").agg(F.count("*").alias("m")).groupBy("s")
               .agg(F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
               .select("s", F.col("top.label").alias("top")))
    minor = prefix.join(largest, "s").filter("label <> top").select(
        "s", F.col("k").alias("k1"), F.col("label").alias("l1"), F.col("n").alias("n1"), F.col("pos").alias("p1"))
    need = percent / (100 + percent) * (F.col("n1") + F.col("n"))
    bound = 1 + F.least(F.col("n1") - F.col("p1"), F.col("n") - F.col("pos")) - 1
    found = minor.join(prefix, "s").filter(
        (F.col("l1") != F.col("label")) & (bound + 1e-6 >= need)
        & (100 * F.least("n", "n1") >= percent * F.greatest("n", "n1")))
    return found.select(F.least("k1", "k").alias("a"), F.greatest("k1", "k").alias("b")).distinct()


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text",
                settings: Settings = Settings()) -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept.

    A text without words has no shingles and is linked with nothing. Texts with equal sets are
    linked. Rows that repeat a key come out once per set size. A row without key is linked with
    nothing, its component_id is null and it is kept. Other columns are not read.
    """
    rows = common.written(sketches(docs, key, text, settings), "sketches")
    owned = rows.filter("k IS NOT NULL AND n_shingles > 0")
    classes = common.written(owned.groupBy("digest", "n_shingles").agg(F.min("k").alias("rep")), "classes")
    lead = owned.select("k", "digest", "n_shingles", "bands").join(
        classes.withColumnRenamed("rep", "k"), ["k", "digest", "n_shingles"]).select("k", "bands")
    banded = lead.dropDuplicates(["k"]).select("k", F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = common.written(banded.join(sizes, "key"), "buckets")
    wanted = members.select(F.col("k").alias("_k")).distinct()
    texts = docs.select(F.col(key).cast("long").alias("k"), common.text_of(text).alias("t"))
    sets = common.written(full_sets(texts.join(wanted.hint("merge"), F.col("k") == F.col("_k"), "left_semi"),
                                    "k", "t", settings.shingle).dropDuplicates(["k"]), "sets")
    first = common.written(confirmed(hub_pairs(members), sets, settings.percent), "links")
    labels = common.components(first, "a", "b")
    pairs = rare_shingle_pairs(sets, common.written(_mixed(members, labels), "mixed"), settings.percent)
    second = confirmed(pairs, sets, settings.percent)
    name = {c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in "ab"}
    across = second.join(name["a"], "a", "left").join(name["b"], "b", "left").select(
        F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    joined = common.components(across, "a", "b").select(F.col("node").alias("label"), F.col("label").alias("top"))
    final = (classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
             .withColumn("label", F.coalesce("label", "rep")).join(joined, "label", "left")
             .select("digest", "n_shingles", F.coalesce("top", "label").alias("component")))
    out = rows.select("k", "n_shingles", "digest").distinct().join(final, ["digest", "n_shingles"], "left")
    component = F.when(F.col("k").isNotNull(), F.coalesce("component", "k"))
    return out.select(F.col("k").alias(key), "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("k"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text",
                     settings: Settings = Settings(5, 80, 36, 5)) -> DataFrame:
    """One document of each near-duplicate group, with all its columns."""
    return common.keep_ids(docs, near_groups(docs, key, text, settings).filter("kept"), key)
