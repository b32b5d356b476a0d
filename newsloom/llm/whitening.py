"""Whitening of embeddings on an exact integer grid.

Entries become whole numbers, so sums and the centred scatter of the distinct vectors are exact
and do not depend on how Spark deals the rows out. Tasks add up their own part; only sums, one
number for each pair of dimensions, reach the driver. There the scatter is factored by Cholesky
with pivoting, and one-sided Jacobi rotations of the triangular factor make its columns orthogonal:
their squared lengths are the eigenvalues, the columns brought to length 1 the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import common

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0 ** 40  # entries beyond it cannot be told from the grid's ends and count as not finite
COMPONENTS = 16
SWEEPS = 60
_EXACT = 2 ** 53


def grid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, x): vectors without null or non-finite entries, each entry as floor(64 c) + 1,000,000."""
    schema = pa.schema([("k", pa.int64()), ("x", pa.list_(pa.int64()))])

    def make(batch: pa.RecordBatch) -> dict:
        lists = batch.column(1)
        good = pc.is_valid(lists).to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten().cast(pa.float64())
        numbers = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
        usable = np.isfinite(numbers) & (np.abs(numbers) <= LARGEST)
        ends = np.cumsum(sizes)
        wrong = np.append(0, np.cumsum(~usable))
        good &= (wrong[ends] == wrong[ends - sizes]) & (sizes > 0)
        kept = numbers[np.repeat(good, sizes)]
        offsets = np.append(0, np.cumsum(sizes[good])).astype(np.int32)
        x = np.floor(kept * SCALE).astype(np.int64) + SHIFT
        return {"k": batch.column(0).filter(pa.array(good)), "x": pa.ListArray.from_arrays(offsets, x)}

    return vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("x")).mapInArrow(
        lambda rows: common.batches(rows, schema, make), "k long, x array<long>")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _add(total: np.ndarray, part: np.ndarray, bound: float) -> np.ndarray:
    """Exact sum of whole numbers; Python's own numbers where 64 bits could overflow."""
    if total.dtype != object and bound >= 2.0 ** 62:
        total = total.astype(object)
    return total + part


def sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """(number of vectors, sum of each dimension)."""
    schema = pa.schema([("i", pa.int64()), ("s", pa.decimal128(38, 0))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, object)
        for batch in rows:
            n += batch.num_rows
            total = total + _matrix(batch.column(0), size).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_pydict(
            {"i": list(range(-1, size)), "s": pa.array([n, *total.tolist()], pa.decimal128(38, 0))}, schema=schema)

    found = dict(fit.select("x").mapInArrow(run, "i long, s decimal(38,0)").groupBy("i").agg(F.sum("s")).collect())
    return int(found.get(-1, 0)), [int(found.get(i, 0)) for i in range(size)]


def scatter(fit: DataFrame, size: int, centre: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact (sums of y, sums of y times y for each pair of dimensions), y the vectors less `centre`."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.decimal128(38, 0))])
    middle = np.array(centre, np.int64)
    upper = np.triu_indices(size)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, square, reach = np.zeros(size, object), np.zeros((size, size), np.int64), 0.0
        for batch in rows:
            y = _matrix(batch.column(0), size) - middle
            plain = plain + y.sum(axis=0).astype(object)
            top = float(np.abs(y).max()) if len(y) else 0.0
            part = top * top * len(y)
            reach += part
            if part < _EXACT:  # products of doubles are exact below this
                own = (y.T.astype(float) @ y.astype(float)).astype(np.int64)
            else:
                own = y.T.astype(object) @ y.astype(object)
            square = _add(square, own, reach)
        yield pa.RecordBatch.from_pydict({
            "i": np.concatenate((np.arange(size), upper[0])).astype(np.int32),
            "j": np.concatenate((np.full(size, -1), upper[1])).astype(np.int32),
            "s": pa.array([int(v) for v in (*plain, *square[upper])], pa.decimal128(38, 0))}, schema=schema)

    rows = (fit.select("x").mapInArrow(run, "i int, j int, s decimal(38,0)")
            .groupBy("i", "j").agg(F.sum("s").alias("s")).collect())
    plain, square = np.zeros(size, object), np.zeros((size, size), object)
    for i, j, s in rows:
        if j < 0:
            plain[i] = int(s)
        else:
            square[i, j] = square[j, i] = int(s)
    return plain, square


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """G with G G' = V for a symmetric V without negative eigenvalues; as many columns as V's rank.

    Each step takes the largest diagonal entry left; rows stand in V's order, so those of G in
    the order of the pivots are a lower triangle.
    """
    size = len(v)
    left, out = np.diag(v).copy(), np.zeros((size, size))
    least = size * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    taken = np.zeros(size, bool)
    for r in range(size):
        pivot = int(np.argmax(np.where(taken, -1.0, left)))
        if left[pivot] <= least:
            return out[:, :r]
        taken[pivot] = True
        out[pivot, r] = np.sqrt(left[pivot])
        rest = ~taken
        out[rest, r] = (v[rest, pivot] - out[rest, :r] @ out[pivot, :r]) / out[pivot, r]
        left[rest] -= out[rest, r] ** 2
    return out


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, in rounds of pairs that share no column."""
    ring = list(range(n + n % 2))
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:len(ring) // 2], ring[::-1], strict=False) if a < n and b < n]
        yield np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues of G G' that are not zero, falling; their unit eigenvectors as columns)."""
    g, n = g.copy(), g.shape[1]
    rounds = list(_rounds(n)) if n > 1 else []
    for _ in range(SWEEPS):
        worst = 0.0
        for a, b in rounds:
            x, y = g[:, a], g[:, b]
            aa, bb, ab = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            cosine = np.abs(ab) / np.sqrt(aa * bb)
            worst = max(worst, float(cosine.max(initial=0.0)))
            turn = cosine > 1e-17
            half = np.where(turn, (bb - aa) / np.where(turn, 2 * ab, 1.0), 0.0)
            t = np.where(turn, np.where(half >= 0, 1.0, -1.0) / (np.abs(half) + np.hypot(half, 1.0)), 0.0)
            c = 1 / np.hypot(t, 1.0)
            g[:, a], g[:, b] = c * x - c * t * y, c * t * x + c * y
        if worst < 1e-15:
            break
    values = (g * g).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    unit = g[:, order] / np.sqrt(values[order])
    lead = unit[np.abs(unit).argmax(axis=0), np.arange(n)] if n else np.zeros(0)
    return values[order], unit * np.where(lead < 0, -1.0, 1.0)


@dataclass
class Space:
    n: int                   # distinct vectors
    total: list[int]         # sum of each dimension
    values: np.ndarray       # leading eigenvalues
    components: np.ndarray   # their unit eigenvectors, as columns
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: int64 where it fits, else Python's own numbers."""
        low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
        reach = self.n * max(abs(low), abs(high)) + max(map(abs, self.total), default=0)
        kind = np.int64 if reach < 2 ** 63 else object
        return x.astype(kind) * self.n - np.array(self.total, kind)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(float) @ self.components / np.sqrt(self.values)


def fitted(fit: DataFrame, size: int, components: int = COMPONENTS) -> Space:
    """Eigenvalues and components of the covariance (divisor n) of the vectors x of `fit`."""
    n, total = sums(fit, size)
    if n == 0:
        return Space(0, total, np.zeros(0), np.zeros((size, 0)), 0.0)
    plain, square = scatter(fit, size, [(2 * s + n) // (2 * n) for s in total])
    exact = n * square - np.outer(plain, plain)  # n * n times the covariance, in whole numbers
    covariance = np.array([[int(v) / (n * n) for v in row] for row in exact], float)
    values, vectors = one_sided_jacobi(pivoted_cholesky(covariance))
    trace = sum(int(exact[i, i]) for i in range(size)) / (n * n)
    return Space(n, total, values[:components], vectors[:, :components], trace)


def identity_error(fit: DataFrame, size: int, space: Space) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, measured on all of `fit`."""
    width = len(space.values)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in rows:
            w = space.whitened(space.centred(_matrix(batch.column(0), size)))
            total[:width] += w.T @ w
            total[width] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32),
                                          "s": total.ravel()}, schema=schema)

    total = np.zeros((width + 1, width))
    for i, j, s in fit.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect():
        total[i, j] = s
    mean = total[width] / space.n
    return float(np.abs(total[:width] / space.n - np.outer(mean, mean) - np.eye(width)).max(initial=0.0))


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
             components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Left out are null and empty vectors and those with a null entry, one that is not finite or one
    beyond 2^40; of what is left, vectors whose length is not the most frequent one among distinct vectors
    (of equally frequent ones the greatest). The space is fitted on distinct vectors; rows that
    repeat, and rows without key, come out as often as they come in. Components without variance
    are left out, so a single distinct vector, like an empty table, gives no rows. A deviation
    beyond 64 bits is null. Other columns are not read.
    """
    rows = grid(vectors, key, vector)
    fit = common.written(rows.select("x").distinct(), "fit")
    lengths = fit.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).head(1)
    size = lengths[0]["size"] if lengths else 0
    fit = fit.filter(F.size("x") == size)
    space = fitted(fit, size, components)
    width = len(space.values)
    error = identity_error(fit, size, space) if width else 0.0
    explained = space.values / space.trace if width else np.zeros(0)
    schema = pa.schema([("k", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def make(batch: pa.RecordBatch) -> dict:
        centred = space.centred(_matrix(batch.column(1), size))
        m = len(centred)
        top = int(np.abs(centred).max()) if m else 0
        if top * top * size >= 2 ** 63:
            squares = [s if s < 2 ** 63 else None for s in (centred.astype(object) ** 2).sum(axis=1).tolist()]
        else:
            squares = (centred * centred).sum(axis=1).tolist()
        deviation = pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(m), width)))
        return {"k": batch.column(0).take(pa.array(np.repeat(np.arange(m), width))),
                "component": np.tile(np.arange(1, width + 1, dtype=np.int32), m), "n": np.full(m * width, space.n, np.int64),
                "deviation": deviation, "whitened": space.whitened(centred).ravel(), "explained": np.tile(explained, m),
                "identity_error": np.full(m * width, error)}

    used = rows.filter(F.size("x") == size) if width else rows.limit(0)
    return used.mapInArrow(lambda parts: common.batches(parts, schema, make),
                           "k long, component int, n long, deviation long, whitened double, explained double, "
                           "identity_error double").withColumnRenamed("k", key)
