"""Leakage-aware splits: hold out building blocks, not rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import SPLIT_SEED, key_hash
from .joins import flag_any
from .sampling import hash_cut


def hold_out(blocks: DataFrame, share: float = 0.1, seed: int = SPLIT_SEED, key: str = "idx") -> tuple[DataFrame, str]:
    """Mark ceil(share * n) blocks as held out.

    Returns the marked dictionary and the hash cut. A block is held out exactly
    when its hash is at most the cut, so any table of block ids can be tested
    with :func:`is_held`, without a join.
    """
    h = key_hash(key, seed=seed)
    cut = hash_cut(blocks, h, math.ceil(share * blocks.count()))
    return blocks.withColumn("held", h <= cut), cut


def is_held(col: str, cut: str, seed: int = SPLIT_SEED) -> Column:
    """Whether the block id in a column is held out."""
    return key_hash(col, seed=seed) <= cut


def split_any(entities: DataFrame, cols: Sequence[str], cut: str, seed: int = SPLIT_SEED) -> DataFrame:
    """Validation if any block is held out, else training; adds ``split``."""
    held = reduce(lambda a, b: a | b, [is_held(c, cut, seed) for c in cols])
    return entities.withColumn("split", F.when(held, "val").otherwise("train"))


def split_strict(entities: DataFrame, cols: Sequence[str], cut: str, seed: int = SPLIT_SEED) -> DataFrame:
    """Training needs every block in training, validation every block held out.

    Entities that mix both are dropped.
    """
    flags = [is_held(c, cut, seed) for c in cols]
    every = reduce(lambda a, b: a & b, flags)
    some = reduce(lambda a, b: a | b, flags)
    split = F.when(every, "val").when(~some, "train")
    return entities.withColumn("split", split).where(F.col("split").isNotNull())


def tag_shared(entities: DataFrame, cols: Sequence[str], distinct_blocks: DataFrame, key: str = "idx") -> DataFrame:
    """Tag rows that use any block of a list as ``nonshared``, the others ``shared``."""
    flagged = flag_any(entities, distinct_blocks, cols, key, "_hit")
    return flagged.withColumn("split_group", F.when(F.col("_hit"), "nonshared").otherwise("shared")).drop("_hit")


def split_report(split: DataFrame, labels: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Rows and positives by split and group, with the share of all rows.

    One pass over the entities; everything after it has a row per split.
    """
    per = split.groupBy("split").agg(
        F.count(F.lit(1)).alias("entities"), *[F.count_if(F.col(c)).alias(c) for c in labels]
    )
    whole = F.sum("entities").over(W.partitionBy(F.lit(0)))  # one row per split
    shares = per.withColumn("share", F.round(F.col("entities") / whole, 6))
    pairs = F.array(*[F.struct(F.lit(g).alias("grp"), F.col(c).alias("positives")) for g, c in zip(groups, labels)])
    return shares.select("split", "entities", "share", F.inline(pairs))


def novel_share(values: DataFrame, known: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """Distinct values over some columns, and the share that a list lacks."""
    used = values.select(F.explode(F.array(*cols)).alias(key)).distinct()
    flagged = used.join(known.select(F.col(key), F.lit(1).alias("_known")).distinct(), key, "left")
    return flagged.agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.round(F.avg(F.col("_known").isNull().cast("double")), 6).alias("novel_share"),
    )
