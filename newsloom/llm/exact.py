"""Exact deduplication with counting quotient filters and byte verification.

Every partition of fingerprints builds one counting quotient filter per block of the
fingerprint space. A 64-bit fingerprint is split into block, quotient and remainder, so a filter
keeps all of it: `occupieds` has a bit per quotient, `runends` a bit per slot, remainders stand
sorted within their run, and counters stand beside the slots that need one. Filters of a block
merge without loss by their sorted remainders. Fingerprints counted more than once lead to their
texts, which are compared whole; all other texts are known to be unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import common

QUOTIENT_BITS = 8
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

U = np.uint64


class CountingQuotientFilter:
    """Multiset of the 64-bit fingerprints that start with `block` (of `block_bits` bits)."""

    def __init__(self, block: int, block_bits: int, values: np.ndarray, counts: np.ndarray):
        self.block, self.block_bits, self.values, self.counts = block, block_bits, values, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, block_bits: int) -> Iterator[CountingQuotientFilter]:
        values, counts = np.unique(fingerprints.astype(U), return_counts=True)
        blocks = values >> U(64 - block_bits)
        at = np.flatnonzero(np.diff(blocks, prepend=U(1) ^ blocks[:1])) if len(values) else []
        for low, high in zip(at, [*at[1:], len(values)], strict=True):
            yield cls(int(blocks[low]), block_bits, values[low:high], counts[low:high].astype(U))

    def to_bytes(self) -> bytes:
        width = 64 - self.block_bits - QUOTIENT_BITS
        quotients = ((self.values >> U(width)) & U((1 << QUOTIENT_BITS) - 1)).astype(np.int64)
        occupieds = np.zeros(1 << QUOTIENT_BITS, bool)
        occupieds[quotients] = True
        runends = np.append(quotients[1:] != quotients[:-1], True)
        many = self.counts > 1
        size = (width + 7) // 8
        remainders = (self.values & U((1 << width) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
        return b"".join((len(self.values).to_bytes(4, "little"), np.packbits(occupieds).tobytes(),
                         np.packbits(runends).tobytes(), np.packbits(many).tobytes(),
                         np.ascontiguousarray(remainders).tobytes(), self.counts[many].astype("<u8").tobytes()))

    @classmethod
    def from_bytes(cls, block: int, block_bits: int, raw: bytes) -> CountingQuotientFilter:
        width, n, at = 64 - block_bits - QUOTIENT_BITS, int.from_bytes(raw[:4], "little"), 4

        def bits(count: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(raw, np.uint8, (count + 7) // 8, at)
            at += len(part)
            return np.unpackbits(part, count=count).astype(bool)

        occupieds, runends, many = bits(1 << QUOTIENT_BITS), bits(n), bits(n)
        size = (width + 7) // 8
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(n, size)
        at += n * size
        run = np.cumsum(runends) - runends
        quotients = np.flatnonzero(occupieds)[run].astype(U)
        values = (U(block) << U(64 - block_bits)) | (quotients << U(width)) | wide.reshape(-1).view("<u8")
        counts = np.ones(n, U)
        counts[many] = np.frombuffer(raw, "<u8", int(many.sum()), at)
        return cls(block, block_bits, values, counts)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Sorted runs into one sorted run; counts of equal fingerprints add up."""
        values = np.concatenate([f.values for f in filters])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], np.concatenate([f.counts for f in filters])[order]
        at = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        return cls(filters[0].block, filters[0].block_bits, values[at], np.add.reduceat(counts, at))


def without_blanks(text: Column) -> Column:
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def repeated_fingerprints(prints: DataFrame, column: str = "fp") -> DataFrame:
    """Distinct non-null fingerprints that occur more than once, as `column`."""
    spark = prints.sparkSession
    block_bits = max(8, (4 * common.partitions(spark)).bit_length())

    def build(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in rows]
        if parts:
            made = list(CountingQuotientFilter.build(np.concatenate(parts).astype(np.int64).view(U), block_bits))
            for at in range(0, len(made), 4096):
                some = made[at:at + 4096]
                yield pa.RecordBatch.from_pydict({"block": [f.block for f in some],
                                                  "filter": [f.to_bytes() for f in some]})

    def merge(rows: pa.Table) -> pa.Table:
        block = rows["block"][0].as_py()
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(block, block_bits, raw.as_py())
                                               for raw in rows["filter"]])
        return pa.table({column: merged.values[merged.counts > 1].view(np.int64)})

    filters = prints.select(column).filter(F.col(column).isNotNull()).mapInArrow(build, "block long, filter binary")
    return filters.groupBy("block").applyInArrow(merge, f"{column} long")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same bytes after deleting blanks; of a group the row with
    the most code points, then the smallest key, stays. A null text is empty, and empty texts are
    a group. Rows that repeat key and text count in group_size and come out once, kept if their
    key stays. A row without key is in no group and stays. Other columns are not read.
    """
    whole = common.text_of(text)
    bare = without_blanks(whole)
    prints = common.written(docs.select(
        F.col(key), F.char_length(whole).alias("n"), F.xxhash64(bare).alias("fp"),
        F.sha2(bare, 256).alias("text_sha256")), "prints")
    owned = prints.filter(F.col(key).isNotNull())
    repeated = common.written(repeated_fingerprints(owned), "repeated")
    suspects = owned.join(repeated, "fp", "left_semi").select(F.col(key).alias("_k")).distinct()
    texts = docs.select(F.col(key), whole.alias("_t"))
    checked = (texts.join(suspects.hint("merge"), F.col(key) == F.col("_k"), "left_semi")
               .select(F.col(key), without_blanks(F.col("_t")).alias("bare"), F.char_length("_t").alias("n"))
               .withColumn("fp", F.xxhash64("bare"))
               .groupBy("fp", "bare").agg(F.count("*").alias("group_size"),
                                          F.min(F.struct((-F.col("n")).alias("n"), F.col(key).alias("k"))).alias("best"))
               .filter("group_size > 1"))
    groups = common.written(checked.select("fp", F.sha2("bare", 256).alias("text_sha256"), "group_size",
                                           F.col("best.k").alias("keep_id")), "groups")
    once = prints.groupBy(key, "fp", "text_sha256").agg(F.max("n").alias("n"))
    joined = once.join(groups, ["fp", "text_sha256"], "left")
    mine = F.col(key).isNotNull() & F.col("keep_id").isNotNull()
    return joined.select(
        F.col(key), F.when(mine, F.col("keep_id")).otherwise(F.col(key)).alias("keep_id"),
        F.when(mine, F.col("group_size")).otherwise(F.lit(1).cast("long")).alias("group_size"),
        F.when(mine, F.col("keep_id") == F.col(key)).otherwise(F.lit(True)).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose row stays in `exact_groups`, each once, with all their columns."""
    return common.keep_ids(docs, exact_groups(docs, key, text).filter("kept"), key, once=text)
