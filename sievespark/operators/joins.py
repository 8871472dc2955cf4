"""Joins of entities with the dictionary and with each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_true


def star_features(
    df: DataFrame, features: DataFrame, cols: Sequence[str], keep: Sequence[str], concat: bool = True
) -> DataFrame:
    """Fetch the feature list of every block id; one list, or one per block.

    ``features`` (idx, features) should be a written table: its file size tells
    Spark whether to broadcast it. See :func:`melt_features` for a large one.
    """
    for i, c in enumerate(cols, 1):
        side = features.select(F.col("idx").alias(f"_k{i}"), F.col("features").alias(f"features{i}"))
        df = df.join(side, F.col(c) == F.col(f"_k{i}"))
    parts = [f"features{i}" for i in range(1, len(cols) + 1)]
    if concat:
        return df.select(*keep, F.concat(*parts).alias("features"))
    return df.select(*keep, *parts)


def melt_features(
    df: DataFrame, features: DataFrame, key: str, cols: Sequence[str], width: int | None = None
) -> DataFrame:
    """The same feature lists by melt, one join, and regrouping.

    For a dictionary too large to broadcast: one join shuffle instead of three.
    Groups hold one list per block column, so collecting them is bounded.
    """
    slots = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(c).alias("idx")) for i, c in enumerate(cols)])
    long = df.select(key, F.inline(slots)).join(features.select("idx", "features"), "idx")
    lists = F.array_sort(F.collect_list(F.struct("pos", "features")))
    wide = long.groupBy(key).agg(lists.alias("_l")).where(F.size("_l") == len(cols))
    return wide.select(key, F.flatten(F.transform("_l", lambda s: s["features"])).alias("features"))


def anti_each(df: DataFrame, keys: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """Rows none of whose columns is in the key list."""
    for c in cols:
        df = df.join(keys.select(F.col(key).alias(c)), c, "left_anti")
    return df


def flag_any(df: DataFrame, keys: DataFrame, cols: Sequence[str], key: str, flag: str) -> DataFrame:
    """Add a flag: is any of the columns in the key list?

    One outer join per column against the distinct keys. Where the keys are too
    many to broadcast, adaptive execution can split the rows of a frequent value,
    which it cannot for existence joins.
    """
    known = keys.select(F.col(key).alias("_key")).distinct()
    for i, c in enumerate(cols):
        df = df.join(known.withColumn(f"_hit{i}", F.lit(True)), F.col(c) == F.col("_key"), "left").drop("_key")
    hits = [f"_hit{i}" for i in range(len(cols))]
    return df.withColumn(flag, any_true(hits)).drop(*hits)


def semi_any(df: DataFrame, keys: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """Rows any of whose columns is in the key list."""
    return flag_any(df, keys, cols, key, "_any").where("_any").drop("_any")


def aligned(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join side by side and tell where a key is missing on one side."""
    a = left.withColumn("_in_left", F.lit(True))
    b = right.withColumn("_in_right", F.lit(True))
    joined = a.join(b, list(on), "full")
    ok = F.col("_in_left").isNotNull() & F.col("_in_right").isNotNull()
    return joined.withColumn("is_aligned", ok).drop("_in_left", "_in_right")
