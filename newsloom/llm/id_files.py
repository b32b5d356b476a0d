"""Token-id files: one compressed frame a document under a shared zstandard dictionary.

A data set is a folder of
  dictionary.zdict    the dictionary, trained on serialized id arrays of short documents
  <name>.ids          files of at most some 32 MB: header, frames in ascending key order
  index/              Parquet: key, file, ids before it in the file, offset, size, n_tokens
The header holds a magic word, the width of an id in bytes and the SHA-256 of the dictionary, so
a file is never read with another one. A short document is read by its index row alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm import common, files
from newsloom.llm.tokens import encoder

MAGIC = b"IDZ1"
HEADER = len(MAGIC) + 4 + 32
FILE_BYTES = 32 << 20
# Bounds of what the dictionary is trained on; every document is written whole whatever they are.
SAMPLE_DOCUMENTS = 1_000
SAMPLE_CHARS = 4_000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3

INDEX = "k long, file string, first_in_file long, offset long, size long, n_tokens long"


def _width(tokenizer: str, end_id: int) -> int:
    return 2 if max(encoder(tokenizer).vocabulary, end_id + 1) <= 1 << 16 else 4


def serialize(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def _coded(text: str, tokenizer: str, end_id: int) -> np.ndarray:
    return np.append(encoder(tokenizer).encode(text), np.uint32(end_id))


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, key: str, text: str) -> bytes:
    """From the short documents of least key hash; empty if there are too few to train on."""
    width = _width(tokenizer, end_id)
    sample = (docs.select(F.xxhash64(key).alias("h"), common.text_of(text).alias("t"))
              .filter(F.char_length("t") <= SAMPLE_CHARS).orderBy("h", "t").limit(SAMPLE_DOCUMENTS)
              .withColumn("one", F.lit(1)))

    def one(rows: pa.Table) -> pa.Table:
        samples = [serialize(_coded(t, tokenizer, end_id), width) for t in rows.sort_by([("h", "ascending"), ("t", "ascending")])["t"].to_pylist()]
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            made = b""  # too few or too small samples
        return pa.table({"made": pa.array([made], pa.binary())})

    row = sample.groupBy("one").applyInArrow(one, "made binary").first()
    return bytes(row["made"]) if row else b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, key: str = "doc_id",
              text: str = "text") -> DataFrame:
    """Write the data set of `docs` and return its index.

    Files hold documents in ascending key order, null keys first; equal keys in the order of their
    texts. A null text is empty and still has its end id. No documents make an empty index. Other
    columns are not read.
    """
    spark, width = docs.sparkSession, _width(tokenizer, end_id)
    trained = train_dictionary(docs, tokenizer, end_id, key, text)
    files.write(folder, "dictionary.zdict", trained)
    head = MAGIC + width.to_bytes(4, "little") + hashlib.sha256(trained).digest()
    sent = spark.sparkContext.broadcast(trained)
    schema = pa.schema([("k", pa.int64()), ("file", pa.string()), ("first_in_file", pa.int64()), ("offset", pa.int64()),
                        ("size", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(sent.value))
        name, out, at, ids_in_file = "", None, 0, 0
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in schema.names[1:]}
            for coded in encoder(tokenizer).encode_all(batch.column(1)):
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, out = files.create(folder, ".ids")
                    out.write(head)
                    at, ids_in_file = HEADER, 0
                ids = np.append(coded, np.uint32(end_id))
                frame = press.compress(serialize(ids, width))
                out.write(frame)
                for column, cell in zip(rows, (name, ids_in_file, at, len(frame), len(ids)), strict=True):
                    rows[column].append(cell)
                at += len(frame)
                ids_in_file += len(ids)
            yield pa.RecordBatch.from_pydict({"k": batch.column(0), **rows}, schema=schema)
        if out is not None:
            out.close()

    ordered = (docs.select(F.col(key).cast("long").alias("k"), common.text_of(text).alias("t"))
               .repartitionByRange("k").sortWithinPartitions("k", "t"))
    ordered.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _reader(folder: str):
    with files.opened(folder, "dictionary.zdict") as file:
        raw = file.read()
    return zstandard.ZstdDecompressor(dict_data=_dictionary(raw)), hashlib.sha256(raw).digest()


def _check(head: bytes, digest: bytes) -> int:
    if head[:4] != MAGIC or head[8:HEADER] != digest:
        raise ValueError("not an id file of this dictionary")
    return int.from_bytes(head[4:8], "little")


def read_ids(index: DataFrame, folder: str) -> DataFrame:
    """Index rows with the ids read back: k, file, first_in_file, n_tokens, ids (32-bit, little-endian)."""
    schema = pa.schema([("k", pa.int64()), ("file", pa.string()), ("first_in_file", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, digest = _reader(folder)
        name, file, width = None, None, 0

        def make(batch: pa.RecordBatch) -> dict:
            nonlocal name, file, width
            out, counts = [], []
            for own, offset, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "size")), strict=True):
                if own != name:
                    if file is not None:
                        file.close()
                    name, file = own, files.opened(folder, own)
                    width = _check(file.read_at(HEADER, 0), digest)
                ids = np.frombuffer(unpress.decompress(file.read_at(size, offset)), f"<u{width}").astype("<u4")
                out.append(ids.tobytes())
                counts.append(len(ids))
            return {"k": batch.column("k"), "file": batch.column("file"), "first_in_file": batch.column("first_in_file"),
                    "n_tokens": counts, "ids": out}

        yield from common.batches(batches, schema, make)
        if file is not None:
            file.close()

    return index.mapInArrow(run, "k long, file string, first_in_file long, n_tokens long, ids binary")


def read_document(spark: SparkSession, folder: str, key: int) -> list[list[int]]:
    """Ids of the documents of one key, by their index rows."""
    rows = spark.read.schema(INDEX).parquet(f"{folder}/index").filter(F.col("k") == key)
    return [np.frombuffer(r["ids"], "<u4").tolist() for r in read_ids(rows, folder).collect()]


def with_starts(index: DataFrame) -> DataFrame:
    """Index rows with `start`: the ids of all documents before each, in key order.

    One row a file takes part in the running sum over files.
    """
    totals = index.groupBy("file").agg(F.min(F.struct("k", "first_in_file")).alias("low"), F.max(F.struct(
        "first_in_file", "n_tokens")).alias("last"), F.max("k").alias("high"))
    order = W.orderBy("low.k", "high", "file").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.withColumn("base", F.coalesce(F.sum(F.col("last.first_in_file") + F.col("last.n_tokens")).over(order), F.lit(0)))
    return index.join(bases.select("file", "base"), "file").withColumn("start", F.col("base") + F.col("first_in_file"))


def id_digests(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """Write, read back: key, start, n_tokens, ids_crc32 per document, all from the files."""
    index = write_ids(docs, folder, tokenizer, end_id, key, text)
    schema = pa.schema([("k", pa.int64()), ("file", pa.string()), ("first_in_file", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def make(batch: pa.RecordBatch) -> dict:
        return {n: batch.column(n) for n in schema.names[:-1]} | {
            "ids_crc32": pa.array([zlib.crc32(x.as_buffer()) for x in batch.column("ids")], pa.int64())}

    spread = index.repartition(4 * common.partitions(docs.sparkSession), "file", F.col("offset").bitwiseAND(-(1 << 22)))
    rows = read_ids(spread.sortWithinPartitions("file", "offset"), folder).mapInArrow(
        lambda b: common.batches(b, schema, make), "k long, file string, first_in_file long, n_tokens long, ids_crc32 long")
    return with_starts(common.written(rows, "digests")).select(F.col("k").alias(key), "start", "n_tokens", "ids_crc32")
