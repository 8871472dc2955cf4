"""Nearest neighbours by Euclidean distance.

A context of checked small size is broadcast, and queries stream past it in Arrow batches
without a shuffle. A larger one is joined by pivots (``pivot_join``), exactly.
Approximate search uses a saved index (``vector_index``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import key_hash
from ..sources.stage import fits_rows, materialize
from .pivot_join import PivotJoin
from .windows import running_totals

BROADCAST_ROWS = 8_192  # contexts up to here are broadcast, if also within the bytes below
BROADCAST_BYTES = 256 << 20
BLOCK_ROWS = 4_096
SLICE_ROWS = 16_384
_WORK_BYTES = 128 << 20

_OUT = "query_id bigint, context_id bigint, dist double"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def top_k(query_ids, queries, context_ids, context, k: int) -> pd.DataFrame:
    """The k nearest context rows of every query, ties by id.

    A matrix product finds candidates; their distances are then computed from
    differences, so equal pairs get equal distances in every task.
    """
    found = []
    m = len(context_ids)
    if m:
        norms = (context * context).sum(axis=1)
        step = max(1, int(_WORK_BYTES / (8 * m * max(context.shape[1], 1))))
        for at in range(0, len(query_ids), step):
            q, ids = queries[at : at + step], query_ids[at : at + step]
            own = (q * q).sum(axis=1)
            rough = own[:, None] + norms - 2.0 * (q @ context.T)
            if m > k:
                edge = np.partition(rough, k - 1, axis=1)[:, k - 1]
                keep = rough <= (edge + 1e-9 * (1.0 + own + norms.max()))[:, None]
                rows, cols = np.nonzero(keep)
            else:
                rows, cols = (x.ravel() for x in np.indices(rough.shape))
            diff = q[rows] - context[cols]
            dist = np.sqrt((diff * diff).sum(axis=1))
            order = np.lexsort((context_ids[cols], dist, rows))
            rows, cols, dist = rows[order], cols[order], dist[order]
            first = np.searchsorted(rows, rows, side="left")
            kept = np.arange(len(rows)) - first < k
            found.append(pd.DataFrame({
                "query_id": ids[rows[kept]], "context_id": context_ids[cols[kept]], "dist": dist[kept]}))
    if not found:
        return pd.DataFrame({"query_id": np.array([], "int64"), "context_id": np.array([], "int64"), "dist": np.array([], "float64")})
    return pd.concat(found, ignore_index=True)


def _broadcast_join(queries: DataFrame, context: DataFrame, k: int) -> DataFrame:
    held = context.toPandas()  # at most BROADCAST_ROWS rows, checked by the caller
    shared = queries.sparkSession.sparkContext.broadcast(
        (held["id"].to_numpy("int64"), _matrix(held["vec"]) if len(held) else np.zeros((0, 1))))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = shared.value
        for b in batches:
            if len(b):
                yield top_k(b["id"].to_numpy("int64"), _matrix(b["vec"]), ids, vectors, k)

    return queries.mapInPandas(scan, _OUT)


def smallest_ids(context: DataFrame, k: int) -> DataFrame:
    """At most k rows of each distinct vector, those with the smallest ids: no others can be among the k nearest."""
    rank = F.row_number().over(W.partitionBy("vec").orderBy("id"))  # limited to k before the shuffle
    return context.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def _sides(queries, context, key, vector):
    cols = (F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    return queries.select(*cols), context.select(*cols)


def nearest(
    queries: DataFrame, context: DataFrame, key: str, vector: str, k: int = 1, broadcast_rows: int = BROADCAST_ROWS,
    pivots: int | None = None, block_rows: int = BLOCK_ROWS, slice_rows: int = SLICE_ROWS, seed: int = 253,
) -> DataFrame:
    """Exact k nearest context rows of every query: (query_id, context_id, dist)."""
    q, c = _sides(queries, context, key, vector)
    c = materialize(c, "context")
    probe = c.select(F.size("vec").alias("n")).head()
    if probe is None:
        raise ValueError("the context is empty")
    if fits_rows(c, broadcast_rows) and broadcast_rows * probe["n"] * 8 <= BROADCAST_BYTES:
        return _broadcast_join(q, c, k)
    few = materialize(smallest_ids(c, k), "context")
    return PivotJoin(materialize(q, "queries"), few, k, top_k, pivots, block_rows, slice_rows, seed).result()


def class_distances(queries: DataFrame, context: DataFrame, key: str, vector: str, positive: str) -> DataFrame:
    """Distance of every query to the nearest positive and the nearest negative row."""
    sides = []
    for name, wanted in (("positive_dist", F.col(positive)), ("negative_dist", ~F.col(positive))):
        found = nearest(queries, context.where(wanted), key, vector, 1)
        sides.append(found.select("query_id", F.col("dist").alias(name)))
    return sides[0].join(sides[1], "query_id")


def distance_report(distances: DataFrame, label: str) -> DataFrame:
    """Mean nearest distances by class of the query: four numbers in two rows."""
    return distances.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.avg("positive_dist").alias("to_positive"), F.avg("negative_dist").alias("to_negative"))


def adjacent_in_order(context: DataFrame, queries: DataFrame, order: list[str], width: int) -> DataFrame:
    """Pairs of queries with the ``width`` context rows before and after them.

    Both tables have ``tree``, the ``order`` columns and ``id``. A query's
    position is the number of context rows up to it; a dense rank makes the
    lookup an equi-join on unique keys.
    """
    both = context.select("tree", *order, "id", F.lit(1).alias("_one")).unionByName(
        queries.select("tree", *order, "id", F.lit(0).alias("_one")))
    ranked = materialize(running_totals(both, ["tree"], [*order, F.desc("_one"), "id"], {"_one": "_rank"}), "order")
    rows = ranked.where(F.col("_one") == 1).select("tree", "_rank", F.col("id").alias("context_id"))
    wanted = ranked.where(F.col("_one") == 0).select(
        "tree", F.col("id").alias("query_id"),
        F.explode(F.sequence(F.col("_rank") - (width - 1), F.col("_rank") + width)).alias("_rank"))
    return wanted.join(rows, ["tree", "_rank"]).select("query_id", "context_id").distinct()


def split_half(df: DataFrame, key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """A reproducible half as context, the rest as queries."""
    first = F.substring(key_hash(key, seed=seed), 1, 1) < "8"
    return df.where(first), df.where(~first)


def blocks_for(rows: int, per_block: int) -> int:
    """Number of blocks that keep a block near ``per_block`` rows."""
    return max(1, math.ceil(rows / per_block))
