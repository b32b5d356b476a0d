"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into overlapping passages of words, weighted by TF-IDF with document frequencies
over the whole corpus. A distributed randomised SVD of the benchmark's passage matrix, a block of items
at a time, gives the latent space: its right singular vectors span what any item can share with a
passage. The matrix is a table of passages; its products with a random and with an orthogonal matrix are
summed from partitions, and only factors with as many rows and columns as a block has passages are taken apart on the driver.
A block has at most `rank` passages, so its space holds every one of them whole and
cosines are those of the full space. All passages of all documents are projected and compared with the block's items by
cosine, both in one sum over words; near ones are candidates. A candidate's surroundings are then compared with the item by
longest common subsequence, and a paraphrase has to hold the item's answer as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import common
from newsloom.llm.words import words


# Passages compared at a time, and numbers gathered at a time for their halves: few, so that they stay near the core.
_CHUNK, _GATHERED = 1024, 1 << 17
# Passages of the benchmark in a task, and random columns beyond their number in the sketch of a block.
_ROWS, _OVERSAMPLE = 64, 16


@dataclass(frozen=True)
class Retrieval:
    half: int = 16          # words of half a passage; passages are two halves long, one half apart
    rank: int = 1_024       # passages of a block, and so the most dimensions of its latent space
    cosine: float = 0.4     # least cosine of a candidate
    share: float = 0.3      # least weight of a passage against the lightest of the items, repeated words alike
    verbatim: float = 0.8   # least part of an item's words in order
    paraphrase: float = 0.6  # the same if the answer is there too
    answer: float = 0.6     # least part of the answer's words in order
    block: int = 1_000      # items read at a time; blocks are made of them


@dataclass
class Block:
    """One block of items, as sent to the tasks."""

    vocabulary: np.ndarray   # sorted word hashes of the items
    idf: np.ndarray          # weight per word of the vocabulary
    near: np.ndarray         # vocabulary x item passages: a word's product with each in the latent space, at weight 1
    item_of: np.ndarray      # item of each passage
    items: list[tuple[int | None, list[int], list[int]]]  # (item_id, words, words of the answer)
    lightest: float


def answer_of(text: str) -> str:
    """What follows the last question mark, or else the last sentence."""
    head, mark, tail = text.rpartition("?")
    if mark and tail.strip():
        return tail
    parts = [p for p in re.split(r"(?<=[.!])\s+|\n", text.strip()) if p.strip()]
    return parts[-1] if parts else ""


def common_subsequence(words_: list[int], masks: dict[int, int], length: int) -> int:
    """Length of the longest common subsequence, a bit per word of the masked side."""
    full = (1 << length) - 1
    state = full
    for word in words_:
        match = masks.get(word)
        if match:
            both = state & match
            state = ((state + both) | (state - both)) & full
    return length - state.bit_count()


def _masks(words_: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, word in enumerate(words_):
        out[word] = out.get(word, 0) | 1 << i
    return out


def _hashes(texts: list[str]) -> list[np.ndarray]:
    found = words(pa.array(texts, pa.string()), fold=True, trim=True)
    return [found.hashes[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]


def _spans(n: int, half: int) -> list[tuple[int, int]]:
    """Passages of a text of n words: the last is not shorter than the others if the text is not."""
    if n <= 2 * half:
        return [(0, n)] if n else []
    starts = [*range(0, n - 2 * half, half), n - 2 * half]
    return [(a, a + 2 * half) for a in starts]


def document_frequencies(docs: DataFrame, text: str, vocabulary: np.ndarray) -> DataFrame:
    """(word, df) over all documents for the words of a sorted vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = sent.value, None
        for batch in rows:
            found = words(batch.column(0), fold=True, trim=True)
            at = np.searchsorted(known, found.hashes)
            at[at == len(known)] = 0
            hit = known[at] == found.hashes
            text_of = np.repeat(np.arange(len(found)), found.counts)[hit]
            pairs = np.unique(text_of * len(known) + at[hit])
            some = np.bincount(pairs % len(known), minlength=len(known))
            total = some if total is None else total + some
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"word": some.astype(np.int64), "df": total[some].astype(np.int64)})

    found = docs.select(F.lower(common.text_of(text))).mapInArrow(run, "word long, df long")
    return found.groupBy("word").agg(F.sum("df").alias("df"))


def _unit_rows(passages: list[bytes], vocabulary: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in the vocabulary, TF-IDF rows of length one over these places, mass of each) of a few passages."""
    at = [np.searchsorted(vocabulary, np.frombuffer(p, np.uint64)) for p in passages]
    own = np.unique(np.concatenate(at))
    rows = np.zeros((len(at), len(own)))
    for row, places in zip(rows, at, strict=True):
        np.add.at(row, np.searchsorted(own, places), idf[places])
    mass = np.array([np.sqrt((idf[places] ** 2).sum()) for places in at])  # as in `candidates`
    return own, rows / np.linalg.norm(rows, axis=1)[:, None], mass


def _random(hashes: np.ndarray, width: int, seed: int = 7) -> np.ndarray:
    """A normal vector for each word, the same in every task."""
    return np.array([np.random.default_rng([seed, h]).standard_normal(width) for h in hashes.tolist()])


def _summed(rows: DataFrame, tasks: int) -> DataFrame:
    """(k, v): the sums of the vectors `v` of each `k`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(v)
                total[k] = total[k] + part if k in total else part
        yield from _vectors(np.array(list(total), np.int32), list(total.values()))

    return rows.repartition(tasks, "k").mapInArrow(run, "k int, v binary")


def _vectors(keys: np.ndarray, vectors) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(keys), common.BATCH_ROWS):
        some = slice(low, low + common.BATCH_ROWS)
        yield pa.RecordBatch.from_pydict({"k": pa.array(keys[some], pa.int32()),
                                          "v": pa.array([v.tobytes() for v in vectors[some]], pa.binary())})


def randomised_svd(passages: DataFrame, vocabulary: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(near, mass) of passages (p, words), the p numbered from 0: for each word of the vocabulary its product with
    each passage in the space of all independent right singular vectors, and the mass of each passage.

    With A the matrix of unit rows: the sketch A·Ω is made in the tasks that hold the rows, its orthogonal
    basis Q on the driver, B = Qᵀ·A and B·Bᵀ as sums of what partitions give, and the factors of the latter on the
    driver. As A = Q·B, a word's vector is its column of B seen from the passages' rows of Q.
    """
    spark = passages.sparkSession
    count = passages.count()
    width, tasks = count + _OVERSAMPLE, -(-count // _ROWS)
    rows = passages.select("p", "words").repartition(tasks)
    sent = spark.sparkContext.broadcast((vocabulary, idf))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, unit, mass = _unit_rows(batch.column(1).to_pylist(), *sent.value)
                made = unit @ _random(sent.value[0][own], width)
                yield pa.RecordBatch.from_pydict({"k": batch.column(0), "mass": pa.array(mass), "v": [y.tobytes() for y in made]})

    made = sorted(rows.mapInArrow(sketch, "k int, mass double, v binary").collect())
    left, size, _ = np.linalg.svd(np.array([np.frombuffer(r["v"]) for r in made]), full_matrices=False)
    basis = left[:, size > 1e-9 * size[0]]
    turned = spark.sparkContext.broadcast(basis)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, unit, _ = _unit_rows(batch.column(1).to_pylist(), *sent.value)
                yield from _vectors(own.astype(np.int32), unit.T @ turned.value[batch.column(0).to_numpy()])

    columns = common.written(_summed(rows.mapInArrow(products, "k int, v binary"), tasks), "svd")

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            part = np.array([np.frombuffer(v) for v in batch.column(1).to_pylist()])
            total = total + part.T @ part if len(part) else total
        if not np.isscalar(total):
            yield from _vectors(np.arange(len(total), dtype=np.int32), total)

    gram = sorted(_summed(columns.mapInArrow(squares, "k int, v binary"), tasks).collect())
    power, inner = np.linalg.eigh(np.array([np.frombuffer(r["v"]) for r in gram]))
    inner = inner[:, power > 1e-12 * power[-1]]
    seen = spark.sparkContext.broadcast(inner @ (inner.T @ basis.T))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = np.array([np.frombuffer(v) for v in batch.column(1).to_pylist()])
                yield from _vectors(batch.column(0).to_numpy(), (part @ seen.value).astype(np.float32))

    near = np.empty((len(vocabulary), count), np.float32)
    for r in columns.mapInArrow(shown, "k int, v binary").collect():
        near[r["k"]] = np.frombuffer(r["v"], np.float32)
    return near, np.array([r["mass"] for r in made])


def parts(found: list[np.ndarray], how: Retrieval) -> Iterator[dict[int, list[tuple[int, int]]]]:
    """{item number: its spans} of blocks of at most `rank` passages; an item may be in several."""
    part: dict[int, list[tuple[int, int]]] = {}
    room = how.rank
    for number, hashes in enumerate(found):
        spans = _spans(len(hashes), how.half)
        while spans:
            part[number] = spans[:room]
            spans, room = spans[room:], room - len(part[number])
            if not room:
                yield part
                part, room = {}, how.rank
    if part:
        yield part


def fit(docs: DataFrame, items: list[tuple[int | None, str]], spans: list[list[tuple[int, int]]], docs_count: int,
        frequencies: DataFrame, vocabulary: np.ndarray, how: Retrieval) -> Block:
    """Latent space of one block of items (item_id, text) with the spans of each."""
    df = np.zeros(len(vocabulary), np.int64)
    counted = frequencies.toPandas()  # at most the vocabulary of a block
    df[counted["word"].to_numpy(np.int64)] = counted["df"].to_numpy(np.int64)
    idf = np.log((1 + docs_count) / (1 + df)) + 0.1

    hashes, answers = _hashes([t for _, t in items]), _hashes([answer_of(t) for _, t in items])
    cut = [(number, words_[a:b].astype(np.uint64).tobytes())
           for number, (words_, own) in enumerate(zip(hashes, spans, strict=True)) for a, b in own]
    passages = docs.sparkSession.createDataFrame([(p, bytearray(w)) for p, (_, w) in enumerate(cut)], "p int, words binary")
    near, mass = randomised_svd(passages, vocabulary, idf)
    return Block(vocabulary, idf.astype(np.float32), near, np.array([n for n, _ in cut], np.int64),
                 [(i, w.tolist(), a.tolist()) for (i, _), w, a in zip(items, hashes, answers, strict=True)],
                 float(mass.min()))


def candidates(found, block: Block, how: Retrieval) -> Iterator[tuple[int, int, int, int]]:
    """(text, item number, first word, word after the last) of passages near an item."""
    hashes = found.hashes
    if not len(hashes):
        return
    at = np.searchsorted(block.vocabulary, hashes)
    at[at == len(block.vocabulary)] = 0
    weight = np.where(block.vocabulary[at] == hashes, block.idf[at], 0).astype(np.float32)
    # Halves start over with every text.
    counts = found.counts
    halves = -(-counts // how.half)
    first_half = np.concatenate(([0], np.cumsum(halves)))
    text_of = np.repeat(np.arange(len(counts)), halves)
    begin = found.first[:-1][text_of] + (np.arange(len(text_of)) - first_half[text_of]) * how.half
    mass = np.add.reduceat(weight.astype(float) ** 2, begin)
    joined = np.append(text_of[1:] == text_of[:-1], False)
    both = mass + np.where(joined, np.append(mass[1:], 0), 0)
    lone = halves[text_of] == 1
    heavy = np.flatnonzero((joined | lone) & (np.sqrt(both) >= how.share * block.lightest))
    if not len(heavy):
        return
    seen = set()
    for low in range(0, len(heavy), _CHUNK):
        yield from _near(found, block, how, heavy[low : low + _CHUNK], (at, weight, text_of, begin, joined, both), seen)


def _near(found, block: Block, how: Retrieval, heavy: np.ndarray, halves: tuple, seen: set) -> Iterator[tuple[int, int, int, int]]:
    """Candidates among some passages, named by their first halves."""
    at, weight, text_of, begin, joined, both = halves
    needed = np.unique(np.concatenate((heavy, heavy[joined[heavy]] + 1)))
    near = block.near
    size = near.shape[1]
    products = np.empty((len(needed), size), np.float32)
    stop = found.first[1:][text_of[needed]]
    step = max(1, _GATHERED // (how.half * size))
    for low in range(0, len(needed), step):
        some = slice(low, low + step)
        place = begin[needed[some]][:, None] + np.arange(how.half)
        inside = place < stop[some][:, None]
        place[~inside] = 0
        products[some] = np.matmul((weight[place] * inside)[:, None, :], near[at[place]])[:, 0]
    place = np.searchsorted(needed, heavy)
    cosine = products[place]
    cosine[joined[heavy]] += products[place[joined[heavy]] + 1]
    least = how.cosine * np.sqrt(both[heavy]).astype(np.float32)
    passage, item = np.divmod(np.flatnonzero(cosine >= least[:, None]), size)
    for h, number in zip(heavy[passage].tolist(), block.item_of[item].tolist(), strict=True):
        t = int(text_of[h])
        length = len(block.items[number][1])
        low = max(int(found.first[t]), int(begin[h]) - length)
        high = min(int(found.first[t + 1]), int(begin[h]) + 2 * how.half + length)
        if (low, number) not in seen:
            seen.add((low, number))
            yield t, number, low, high


def item_masks(block: Block) -> list[tuple[int, dict[int, int], int, dict[int, int], int]]:
    return [(i, _masks(w), len(w), _masks(a), len(a)) for i, w, a in block.items]


def confirmed(texts: pa.Array, block: Block, masks: list, how: Retrieval) -> dict[tuple[int, int], tuple[float, float, int]]:
    """{(text, item_id): (coverage, answer coverage, minus the first word looked at)}, the best place of each."""
    found, best = words(texts, fold=True, trim=True), {}
    for t, number, low, high in candidates(found, block, how):
        item_id, item, n, answer, m = masks[number]
        region = found.hashes[low:high].tolist()
        coverage = common_subsequence(region, item, n) / n
        if coverage < how.paraphrase:
            continue
        held = common_subsequence(region, answer, m) / m if m else 1.0
        if coverage >= how.verbatim or held >= how.answer:
            row = (coverage, held, int(found.first[t]) - low)
            best[t, item_id] = max(best.get((t, item_id), row), row)
    return best


def matches(docs: DataFrame, block: Block, how: Retrieval, key: str, text: str) -> DataFrame:
    """(k, item_id, coverage, answer_coverage, start): confirmed items, the best place of each."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    schema = pa.schema([("k", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()),
                        ("answer_coverage", pa.float64()), ("start", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        masks = item_masks(own)

        def make(batch: pa.RecordBatch) -> dict:
            keys, best = batch.column(0).to_pylist(), confirmed(batch.column(1), own, masks, how)
            return {"k": [keys[t] for t, _ in best], "item_id": [i for _, i in best],
                    "coverage": [r[0] for r in best.values()], "answer_coverage": [r[1] for r in best.values()],
                    "start": [-r[2] for r in best.values()]}

        yield from common.batches(rows, schema, make)

    return docs.select(F.col(key).cast("long"), F.lower(common.text_of(text))).mapInArrow(
        run, "k long, item_id long, coverage double, answer_coverage double, start long")


def blocks(docs: DataFrame, benchmark: DataFrame, how: Retrieval, text: str, unnamed: bool = False) -> Iterator[Block]:
    """The benchmark in blocks of items, one an item_id and text; blank ones match nothing, nor do those without
    item_id unless `unnamed`."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(common.text_of("text")).alias("t"))
    items = items.filter(F.col("t").rlike(r"[^\x20\x09-\x0D]") & (F.col("item_id").isNotNull() | F.lit(unnamed))).distinct()
    count = items.count()
    if not count:
        return
    items = common.written(items.withColumn("block", F.pmod(F.xxhash64("item_id", "t"), F.lit(-(-count // how.block)))), "items")
    total = docs.count()
    for number in [r["block"] for r in items.select("block").distinct().orderBy("block").collect()]:
        rows = [tuple(r) for r in items.filter(F.col("block") == number).select("item_id", "t").orderBy("item_id", "t").collect()]
        found = _hashes([t for _, t in rows])
        for part in parts(found, how):
            vocabulary = np.unique(np.concatenate([found[n][a:b] for n, spans in part.items() for a, b in spans]))
            yield fit(docs, [rows[n] for n in part], list(part.values()), total, document_frequencies(docs, text, vocabulary),
                      vocabulary, how)


def contaminated(docs: DataFrame, benchmark: DataFrame, how: Retrieval = Retrieval(), key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, contaminated, item_ids (sorted), coverage (the best, else 0).

    Null and blank texts match nothing. Rows that repeat a key share what was found under it; rows
    without key share what was found in any of them. Other columns are not read.
    """
    found = None
    for block in blocks(docs, benchmark, how, text):
        some = matches(docs, block, how, key, text)
        found = some if found is None else found.union(some)
    keys = docs.select(F.col(key).cast("long").alias(key))
    if found is None:
        return keys.select(key, F.lit(False).alias("contaminated"),
                           F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("coverage"))
    per_text = found.groupBy("k").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"),
                                      F.max("coverage").alias("coverage"))
    joined = keys.join(per_text, F.col(key).eqNullSafe(F.col("k")), "left")
    return joined.select(key, F.col("item_ids").isNotNull().alias("contaminated"),
                         F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
                         F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, how: Retrieval = Retrieval(),
                      text: str = "text") -> DataFrame:
    """Rows of `docs` that hold no benchmark item, with all their columns; each row is judged by itself, in place."""
    kept = docs
    for block in blocks(docs, benchmark, how, text, unnamed=True):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(rows: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            masks = item_masks(own)
            for batch in rows:
                bad = np.zeros(batch.num_rows, bool)
                bad[[t for t, _ in confirmed(batch.column(batch.num_columns - 1), own, masks, how)]] = True
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(~bad))

        lowered = kept.select(*kept.columns, F.lower(common.text_of(text)))
        kept = lowered.mapInArrow(run, docs.schema)
    return kept
