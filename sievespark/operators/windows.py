"""Numbering and running totals that do not put a table through one task.

A window without a partition, or one over a handful of groups, sorts everything
in a few tasks. Here the rows are range-partitioned by the ordering columns and
written; each partition is numbered or summed on its own, and the totals of the
partitions before it (one small row per partition) are added by a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stage import materialize

_LOCAL_POSITION_BITS = (1 << 33) - 1


def ranged(df: DataFrame, *order: str | Column, keep: Sequence[str] | None = None) -> DataFrame:
    """A written copy in range order with partition number and local position.

    Both are stored as data, so later passes cannot see another partitioning.
    ``keep`` names the columns to write; the order columns may be left out.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_POSITION_BITS)))
    )
    return materialize(placed if keep is None else placed.select(*keep, "_pid", "_pos"), "ranged")


def dense_index(
    df: DataFrame, order: Sequence[str | Column], name: str = "idx", keep: Sequence[str] | None = None
) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the given (total) order; ``keep`` narrows the output."""
    rows = ranged(df, *order, keep=keep)
    # One row per partition, so this window is bounded by the partition count.
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_pid", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    return (
        rows.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_offset") + F.col("_pos"))
        .drop("_pid", "_pos", "_offset")
    )


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], values: dict[str, str], bounded: bool = False
) -> DataFrame:
    """Running sums within ``by`` in ``order``; ``values`` maps input to output.

    ``order`` must not tie within a group. With ``bounded`` the caller states that
    each group has few rows (for instance one per rounded score) and a plain
    window is used; otherwise a group may be spread over many tasks.
    """
    if bounded:
        w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.select("*", *[F.sum(v).over(w).alias(out) for v, out in values.items()])
    rows = ranged(df, *by, *order).drop("_pos")
    local = W.partitionBy("_pid", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = rows.select("*", *[F.sum(v).over(local).alias(out) for v, out in values.items()])
    # A group spans consecutive partitions: at most one row per group and partition.
    before = W.partitionBy(*by).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("_pid", *by).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    shifts = totals.select(
        "_pid", *by, *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_s_{v}") for v in values]
    )
    keys = ["_pid", *by]
    joined = summed.join(shifts, keys) if by else summed.join(F.broadcast(shifts), "_pid")
    return joined.select(
        *df.columns, *[(F.col(out) + F.col(f"_s_{v}")).alias(out) for v, out in values.items()]
    )


def row_number_in(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "n") -> DataFrame:
    """Position 1, 2, ... within groups of any size, in a total order."""
    counted = running_totals(df.withColumn("_one", F.lit(1)), by, order, {"_one": name})
    return counted.drop("_one").withColumn(name, F.col(name).cast("int"))


def row_ranges(df: DataFrame, order: Sequence[str | Column], parts: int, name: str = "part") -> DataFrame:
    """Split a table into equal row ranges: floor(position / rows * parts)."""
    numbered = dense_index(df, order, "_row")
    rows = df.count()
    return numbered.withColumn(
        name, F.floor(F.col("_row").cast("double") / F.lit(float(max(rows, 1))) * parts).cast("int")
    ).drop("_row")


def permutation(df: DataFrame, key: str, seed: int, name: str = "position") -> DataFrame:
    """A reproducible random order of the rows, as a position column."""
    from ..functions.columns import key_hash

    return dense_index(df.withColumn("_h", key_hash(key, seed=seed)), ["_h"], name, keep=df.columns)
