"""Reproducible sampling, balancing and random splits.

Every sampler orders rows by a hash of a key and a seed. "The n rows with the
smallest hash" is found as a cut value: a histogram over hash prefixes narrows
it down, so that no sample, however large, is sorted or sent through one task.
Applying the cut is a filter, without a shuffle. Keys must be unique.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import hash_number, key_hash
from ..sources.stage import materialize

_TOP_N_ROWS = 10_000  # up to here one bounded top-n pass is cheaper than histograms
_PREFIX_DIGITS = 4  # 65,536 histogram bins per level
_LAST = "g"  # sorts after every hex digit
_FIRST = ""


def hash_cut(df: DataFrame, hashed: Column, n: int) -> str:
    """The n-th smallest hash; rows with a hash up to it are the sample."""
    if n <= 0:
        return _FIRST
    hashes = df.select(hashed.alias("_h"))
    if n <= _TOP_N_ROWS:
        found = hashes.orderBy("_h").limit(n).agg(F.max("_h"), F.count(F.lit(1))).head()
        return found[0] if found[1] == n else _LAST
    prefix, need = "", n
    while True:
        bins = (
            hashes.where(F.col("_h").startswith(prefix))
            .groupBy(F.substring("_h", len(prefix) + 1, _PREFIX_DIGITS).alias("_bin"))
            .agg(F.count(F.lit(1)).alias("_rows"))
        )
        # At most 65,536 bins, whatever the table holds.
        upto = F.sum("_rows").over(W.orderBy("_bin"))
        edge = bins.select("_bin", "_rows", upto.alias("_upto")).where(F.col("_upto") >= need).orderBy("_bin").head()
        if edge is None:
            return _LAST
        prefix, need = prefix + edge["_bin"], need - (edge["_upto"] - edge["_rows"])
        if edge["_rows"] <= _TOP_N_ROWS or len(prefix) >= 32:
            inside = hashes.where(F.col("_h").startswith(prefix)).orderBy("_h").limit(need)
            return inside.agg(F.max("_h")).head()[0]


def sample_exact(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """Exactly n rows (all, if there are fewer)."""
    h = key_hash(key, seed=seed)
    return df.where(h <= hash_cut(df, h, n))


def sample_per_group(df: DataFrame, group: str, key: str, quota: int, seed: int) -> DataFrame:
    """Up to ``quota`` rows of every group; rows without a group form one.

    A histogram of 12-bit hash prefixes per group tells which prefix holds the
    quota-th row; only rows with that prefix are ranked, so one large group costs
    its ranking task a 4,096th of its rows. The sample is the rows up to the hash
    found for their group; a group with fewer rows than the quota stays whole.
    """
    if quota <= 0:
        return df.limit(0)
    h = df.select(F.col(group).alias("_g"), key_hash(key, seed=seed).alias("_h")).withColumn("_bin", F.substring("_h", 1, 3))
    bins = h.groupBy("_g", "_bin").agg(F.count(F.lit(1)).alias("_rows"))
    w = W.partitionBy("_g").orderBy("_bin")
    holds = bins.withColumn("_upto", F.sum("_rows").over(w)).where(
        (F.col("_upto") >= quota) & (F.col("_upto") - F.col("_rows") < quota))
    edges = materialize(holds.select(
        F.col("_g").alias("_k"), F.col("_bin").alias("_edge"), (quota - (F.col("_upto") - F.col("_rows"))).alias("_need")), "edges")
    at_edge = h.join(edges, h["_g"].eqNullSafe(edges["_k"]) & (h["_bin"] == edges["_edge"]))
    rank = F.row_number().over(W.partitionBy("_g").orderBy("_h"))
    cuts = materialize(at_edge.withColumn("_rank", rank).where(F.col("_rank") == F.col("_need")).select(
        F.col("_g").alias("_k"), F.col("_h").alias("_cut")), "cuts")
    kept = df.join(cuts, df[group].eqNullSafe(cuts["_k"]), "left")
    return kept.where(F.col("_cut").isNull() | (key_hash(key, seed=seed) <= F.col("_cut"))).select(*df.columns)


def _with_negatives(df: DataFrame, positive: Column, key: str, n: int, seed: int) -> DataFrame:
    """All positives and ``n`` negatives (those that exist)."""
    h = key_hash(key, seed=seed)
    return df.where(positive | (h <= hash_cut(df.where(~positive), h, n)))


def undersample(df: DataFrame, positive: Column, key: str, ratio: float, seed: int) -> DataFrame:
    """All positives and ``ratio`` times as many negatives (those that exist)."""
    positive = F.coalesce(positive, F.lit(False))
    return _with_negatives(df, positive, key, int(df.where(positive).count() * ratio), seed)


def oversample(df: DataFrame, positive: Column, target: float) -> DataFrame:
    """Repeat positives ceil(target / current share) extra times; adds ``copy``."""
    positive = F.coalesce(positive, F.lit(False))
    n, n_pos = df.agg(F.count(F.lit(1)), F.count_if(positive)).head()
    extra = math.ceil(target / (n_pos / n)) if n_pos else 0
    copies = F.when(positive, F.sequence(F.lit(0), F.lit(extra))).otherwise(F.array(F.lit(0)))
    return df.select("*", F.explode(copies).alias("copy"))


def oversample_exact(df: DataFrame, positive: Column, key: str, target: float, seed: int) -> DataFrame:
    """Repeat positives until their share is ``target`` (to within one row)."""
    positive = F.coalesce(positive, F.lit(False))
    n, n_pos = df.agg(F.count(F.lit(1)), F.count_if(positive)).head()
    missing = max(0, math.ceil((target * n - n_pos) / (1 - target))) if n_pos else 0
    whole, rest = divmod(missing, n_pos) if n_pos else (0, 0)
    h = key_hash(key, seed=seed)
    cut = hash_cut(df.where(positive), h, rest)
    extra = F.when(h <= cut, whole + 1).otherwise(whole) if rest else F.lit(whole)
    copies = F.when(positive, F.sequence(F.lit(0), extra)).otherwise(F.array(F.lit(0)))
    return df.select("*", F.explode(copies).alias("copy"))


def sample_groups(df: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """All rows of n whole groups, drawn without replacement."""
    h = key_hash(group, seed=seed)
    return df.where(h <= hash_cut(df.select(group).distinct(), h, n))


def random_split(df: DataFrame, key: str, parts: int, seed: int, name: str = "split") -> DataFrame:
    """Assign every row to one of ``parts`` random splits."""
    return df.withColumn(name, F.pmod(hash_number(key_hash(key, seed=seed)), F.lit(parts)).cast("int"))


def class_ratio(df: DataFrame, label: str, key: str, balance: float, seed: int) -> DataFrame:
    """All positives and int(positives / balance) negatives."""
    positive = F.coalesce(F.col(label) == 1, F.lit(False))
    return _with_negatives(df, positive, key, int(df.where(positive).count() / balance), seed)


def quota_sample(df: DataFrame, group: str, key: str, total: int, seed: int) -> DataFrame:
    """A sample of ``total`` rows shared evenly over the groups."""
    n_groups = df.select(group).distinct().count()
    return sample_per_group(df, group, key, total // max(n_groups, 1), seed)


def counts_by(df: DataFrame, *cols: str, name: str = "n") -> DataFrame:
    """Row counts per combination."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all tables, matched by column name."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def difference(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is absent on the other side; repeats are kept."""
    return left.join(right, list(on), "left_anti")


def intersection(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is present on the other side; repeats are kept."""
    return left.join(right, list(on), "left_semi")
