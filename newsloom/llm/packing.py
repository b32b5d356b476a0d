"""Packing token streams into fixed windows with a controlled mixture of sources.

Each source is a queue of its documents' tokens. Deficit round-robin gives every queue in every
window a quantum of window * share tokens; what a queue could not take as a whole number of tokens
is its deficit and carries over to the next window. Served that way, the p-th token of a queue
with rate r leaves at time (p + 1/2) / r, and window k holds the tokens that leave as numbers
k * window to (k + 1) * window - 1. So the state of all queues before any window (tokens taken,
deficits) follows from the queues' totals alone: a task serves the windows that its documents
reach, going on exactly where other tasks leave off. A queue that runs dry leaves its share to
the others in proportion. Every window but the last is full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm import common
from newsloom.llm.tokens import encoder

WINDOW = 4096
# A mixture is a short table of queues; its totals go to every task. The largest sources have queues
# of their own, all others share some by hash.
MOST_SOURCES, SHARED_QUEUES = 10_000, 256
_OFFERS = 6
_BLOCK = 64
_KEEP = 256


class Mixture:
    """Deficit round-robin over queues of `totals` tokens served at `rates`."""

    def __init__(self, totals: np.ndarray, rates: np.ndarray, window: int):
        self.totals, self.rates, self.window = totals.astype(np.int64), rates.astype(float), window
        self.all = int(self.totals.sum())
        self.windows = -(-self.all // window)
        dry = self.totals / self.rates
        times = np.unique(np.concatenate(([0.0], dry)))
        self.times, self.served = times, np.array([np.minimum(self.totals, self.rates * t).sum() for t in times])
        self._at: dict[int, np.ndarray] = {}

    def taken(self, k: np.ndarray) -> np.ndarray:
        """Tokens that each queue has given before each window of `k`: the first k * window to leave."""
        want = np.minimum(k.astype(np.int64) * self.window, self.all)
        t = np.interp(want, self.served, self.times)
        low = np.floor(t[:, None] * self.rates + 0.5).astype(np.int64) - 2
        low = np.clip(low, 0, self.totals)
        missing = want - low.sum(axis=1)
        step = np.arange(_OFFERS)
        offers = low[:, :, None] + step
        leave = np.where(offers < self.totals[None, :, None], (offers + 0.5) / self.rates[None, :, None], np.inf)
        flat = leave.reshape(len(k), -1)
        rank = np.argsort(np.argsort(flat, axis=1, kind="stable"), axis=1)
        return low + (rank < missing[:, None]).reshape(leave.shape).sum(axis=2)

    def block(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """(`taken`, offset of each queue's tokens in its windows) of windows at .. at + _BLOCK, a row a queue.

        The last few hundred blocks are kept.
        """
        if at not in self._at:
            if len(self._at) >= _KEEP:
                self._at.clear()
            taken = np.ascontiguousarray(self.taken(np.arange(at, at + _BLOCK + 1)).T)
            given = np.diff(taken, axis=1)
            self._at[at] = taken, np.cumsum(given, axis=0) - given
        return self._at[at]

    def pieces(self, queue: int, start: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(window, offset in it, first and last + 1 of the tokens) over tokens start .. start + length - 1 of a queue."""
        guess = int(np.interp((start + 0.5) / self.rates[queue], self.times, self.served)) // self.window
        at = guess - guess % _BLOCK
        while at > 0 and self.block(at)[0][queue, 0] > start:
            at -= _BLOCK
        while at + _BLOCK < self.windows and self.block(at)[0][queue, -1] <= start:
            at += _BLOCK
        while True:
            taken, offsets = self.block(at)
            own = taken[queue]
            low = max(int(np.searchsorted(own, start, "right")) - 1, 0)
            high = min(int(np.searchsorted(own, start + length, "left")), _BLOCK)
            bounds, before = own[low:high + 1].tolist(), offsets[queue, low:high].tolist()
            for j, offset in enumerate(before):
                a, b = max(bounds[j], start), min(bounds[j + 1], start + length)
                if a < b:
                    yield at + low + j, offset + a - bounds[j], a - start, b - start
            if at + _BLOCK >= self.windows or own[-1] >= start + length:
                return
            at += _BLOCK


def encoded(docs: DataFrame, tokenizer: str, end_id: int, key: str, text: str, source: str) -> DataFrame:
    """(k, source, part, local, n, ids) per row; `local` counts the source's ids before it in `part`."""
    schema = pa.schema([("k", pa.int64()), ("source", pa.string()), ("part", pa.int32()), ("local", pa.int64()),
                        ("n", pa.int64()), ("ids", pa.binary())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), {}
        code = encoder(tokenizer)
        kind = "<u2" if max(code.vocabulary, end_id + 1) <= 1 << 16 else "<u4"

        def make(batch: pa.RecordBatch) -> dict:
            sources, local, n, ids = batch.column(1).to_pylist(), [], [], []
            for name, coded in zip(sources, code.encode_all(batch.column(2)), strict=True):
                one = np.append(coded, np.uint32(end_id)).astype(kind)
                local.append(so_far.get(name, 0))
                n.append(len(one))
                ids.append(one.tobytes())
                so_far[name] = local[-1] + len(one)
            return {"k": batch.column(0), "source": sources, "part": np.full(len(n), part, np.int32),
                    "local": local, "n": n, "ids": ids}

        yield from common.batches(rows, schema, make)

    return docs.select(F.col(key).cast("long"), F.coalesce(F.col(source).cast("string"), F.lit("")),
                       common.text_of(text)).mapInArrow(run, "k long, source string, part int, local long, n long, ids binary")


def _queues(rows: DataFrame, named: list[str]) -> tuple[DataFrame, list]:
    """(queue and start of each part of a source, totals of the queues by name).

    The largest MOST_SOURCES sources, after those in `named`, have queues by their names; the others
    are dealt to shared queues, one after the other within each.
    """
    parts = common.written(rows.groupBy("source", "part").agg(F.max(F.col("local") + F.col("n")).alias("ids_in_part")), "parts")
    sizes = parts.groupBy("source").agg(F.sum("ids_in_part").alias("ids"))
    own = sizes.orderBy(F.col("source").isin(named).desc(), F.col("ids").desc(), "source").limit(MOST_SOURCES)
    shared = F.concat(F.lit("\u0000shared "), F.pmod(F.xxhash64("source"), F.lit(SHARED_QUEUES)).cast("string"))
    queued = parts.join(own.select("source", F.col("source").alias("queue")), "source", "left").withColumn(
        "queue", F.coalesce("queue", shared))
    before = W.partitionBy("queue").orderBy("source", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = common.written(queued.withColumn("base", F.coalesce(F.sum("ids_in_part").over(before), F.lit(0))), "queues")
    totals = starts.groupBy("queue").agg(F.sum("ids_in_part").alias("ids")).orderBy("queue").collect()
    return starts.drop("ids_in_part"), totals


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW,
         shares: Mapping[str, float] | None = None, key: str = "doc_id", text: str = "text",
         source: str = "source", with_ids: bool = True) -> DataFrame:
    """Pieces of the documents' ids: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, source
    and, unless left out, the ids.

    A document's ids are those of its whole text and `end_id`; a null text is empty and a null
    source the source ''. `shares` are target proportions (sources not named get none until the
    others are dry); by default each source's part of all tokens, so that all last to the end. Any
    number of sources packs: beyond MOST_SOURCES, small ones share queues and are taken in turn there.
    Every row is packed, a null or repeated key like any other. No documents, no pieces.
    """
    rows = common.written(encoded(docs, tokenizer, end_id, key, text, source), "ids")
    starts, totals = _queues(rows, sorted(shares or {}))
    names = [r["queue"] for r in totals]
    sizes = np.array([r["ids"] for r in totals], np.int64)
    rates = sizes.astype(float) if shares is None else np.array([max(float(shares.get(n, 0.0)), 1e-9) for n in names])
    number = {name: i for i, name in enumerate(names)}
    wide = 2 if max(encoder(tokenizer).vocabulary, end_id + 1) <= 1 << 16 else 4
    schema = pa.schema([("k", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                        ("source", pa.string()), *([("ids", pa.binary())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = Mixture(sizes, rates, window)

        def make(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {name: [] for name in schema.names}
            columns = list(out.values())
            keys, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            places, counts, queues = (batch.column(i).to_pylist() for i in (2, 3, 5))
            for k, name, place, n, ids, queue in zip(keys, sources, places, counts, batch.column(4), queues, strict=True):
                raw = np.frombuffer(ids.as_buffer(), f"<u{wide}").astype("<u4").tobytes()
                for window_, offset, a, b in mixture.pieces(number[queue], place, n):
                    piece = raw[4 * a:4 * b]
                    values = (k, a, b - a, zlib.crc32(piece), n, window_, offset, name, piece)
                    for column, value in zip(columns, values, strict=False):
                        column.append(value)
            return out

        yield from common.batches(batches, schema, make)

    placed = rows.join(starts, ["source", "part"]).select(
        "k", "source", (F.col("base") + F.col("local")).alias("place"), "n", "ids", "queue")
    out = placed.mapInArrow(run, "k long, start long, length long, ids_crc32 long, doc_tokens long, "
                                 "sequence_id long, offset long, source string" + ", ids binary" * with_ids)
    return out.withColumnRenamed("k", key)
