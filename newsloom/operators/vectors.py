"""Nearest vectors by cosine: cells around sampled centres, exact ranking inside the cells that are looked at."""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.text import dot
from newsloom.session import cut_lineage

CELLS = 16
# A task compares at most about so many vectors with so many queries, some of them at a time.
UNIT_ROWS, QUERY_ROWS, AT_A_TIME = 8192, 8192, 256
# Decimal places kept of a cosine, so that ties are ties whatever order a sum was taken in.
PLACES = 9


def unit_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, unit): vectors of length one. Rows without a direction have no row here: null vectors or
    entries, no entries, only zeros, or entries that are not finite."""
    wide = F.transform(vector, lambda v: v.cast("double"))
    sized = rows.select(F.col(key).alias("id"), wide.alias("v")).withColumn("size", F.sqrt(dot(F.col("v"), F.col("v"))))
    usable = (F.col("size") > 0) & ~F.isnan("size") & (F.col("size") < math.inf)
    return sized.filter(usable).select("id", F.transform("v", lambda v: v / F.col("size")).alias("unit"))


def centres(units: DataFrame, cells: int = CELLS) -> list[list[float]]:
    """`cells` vectors, those with the least hash of their id: a sample of that bound, whatever the table's size."""
    picked = units.select("unit", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(cells)
    return [list(r["unit"]) for r in picked.collect()]


def _cells(unit: Column, around: list[list[float]], count: int) -> Column:
    """Numbers of the `count` nearest centres, the nearest first, the lower number of equals."""
    table = F.from_json(F.lit(json.dumps(around)), "array<array<double>>")
    near = F.transform(table, lambda c, i: F.struct(F.round(-F.coalesce(dot(c, unit), F.lit(-2.0)), PLACES).alias("d"), i.alias("cell")))
    return F.slice(F.sort_array(near), 1, count)["cell"]


def _by_length(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    lengths, values = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out = {}
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        out[int(n)] = rows, values[starts[rows][:, None] + np.arange(n)[None, :]]
    return out


def _nearest_of(asked: pa.Table, stored: pa.Table, k: int) -> pa.Table:
    """The k nearest of a block of vectors for each query of a block; ties by id."""
    made: list[pa.Table] = []
    names = ["query_id", "id", "similarity"]
    if not len(asked) or not len(stored):
        return pa.table([asked["query_id"].slice(0, 0), stored["id"].slice(0, 0), pa.array([], pa.float64())], names)
    asked_ids, ids = asked["query_id"].combine_chunks(), stored["id"].combine_chunks()
    # Places in the order of ids, as ids may be of any type.
    order = np.empty(len(ids), np.int64)
    order[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    codes = pa.concat_arrays([asked_ids, ids]).dictionary_encode().indices.to_numpy()
    own, other = codes[:len(asked_ids)], codes[len(asked_ids):]
    units, queries = _by_length(stored["unit"].combine_chunks()), _by_length(asked["q"].combine_chunks())
    for length in queries.keys() & units.keys():
        (all_rows, q), (columns, u) = queries[length], units[length]
        for start in range(0, len(all_rows), AT_A_TIME):
            rows = all_rows[start:start + AT_A_TIME]
            near = np.round(np.clip(q[start:start + AT_A_TIME] @ u.T, 0.0, 1.0), PLACES)
            near[own[rows][:, None] == other[columns][None, :]] = -1.0
            least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(rows), -0.5)
            r, c = np.nonzero(near >= np.maximum(least, -0.5)[:, None])
            place = np.lexsort((order[columns[c]], -near[r, c], r))
            r, c = r[place], c[place]
            first = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(rows)))[:-1]])
            kept = np.arange(len(r)) - first[r] < k
            r, c = r[kept], c[kept]
            made.append(pa.table([asked_ids.take(pa.array(rows[r])), ids.take(pa.array(columns[c])), pa.array(near[r, c])], names))
    return pa.concat_tables(made) if made else pa.table([asked_ids.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64())], names)


def nearest(queries: DataFrame, units: DataFrame, k: int = 10, cells: int = CELLS, probes: int | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest other vectors of each query, ties by id.

    `queries` and `units` come from `unit_vectors`. Every vector lies in the cell of its nearest centre;
    a query looks at the `probes` nearest cells, with None at all of them, which is exact. A cell is cut into blocks by id
    that meet blocks of queries, each in a task of its own that multiplies two matrices and hands on k rows a query, so
    neither a crowded cell nor the pairs pass through one task. The cosine is
    clamped to [0, 1] like `cosine`; vectors of another length than the query's are no neighbours. The pairs may serve `scored_threads` as its shortlist for vectors.
    """
    around = centres(units, cells)
    if not around:
        return queries.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    stored = cut_lineage(units.filter("id IS NOT NULL").select("id", "unit", F.explode(_cells(F.col("unit"), around, 1)).alias("cell")))
    looked = _cells(F.col("unit"), around, len(around) if probes is None else probes)
    # Written once, and dealt to its cells from there.
    asked = cut_lineage(queries.filter("id IS NOT NULL").select(F.col("id").alias("query_id"), F.col("unit").alias("q"), looked.alias("cells"))).select(
        "query_id", "q", F.explode("cells").alias("cell"))
    parts = stored.groupBy("cell").agg(F.ceil(F.count("*") / UNIT_ROWS).cast("int").alias("parts")).join(
        asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("asked_parts")), "cell")

    def place(side: DataFrame, key: str, own: str, mine: str, other: str, theirs: str) -> DataFrame:
        return side.join(parts, "cell").select(
            "*", F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs)).drop(
            "parts", "asked_parts")

    keys = ["cell", "part", "asked_part"]
    a = place(asked, "query_id", "asked_parts", "asked_part", "parts", "part").groupBy(*keys)
    b = place(stored, "id", "parts", "part", "asked_parts", "asked_part").groupBy(*keys)
    kinds = [side.schema[c].dataType.simpleString() for side, c in ((asked, "query_id"), (stored, "id"))]
    pairs = a.cogroup(b).applyInArrow(lambda q, u: _nearest_of(q, u, k), f"query_id {kinds[0]}, id {kinds[1]}, similarity double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
