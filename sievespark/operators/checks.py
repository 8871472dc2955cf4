"""Quality checks. Each returns a small table; ``require`` turns one into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The tolerances of a closeness test on probabilities.
RTOL = 1e-5
ATOL = 1e-8


class CheckFailed(Exception):
    """A quality check found offending rows."""


def require(report: DataFrame, **expected) -> None:
    """Raise unless the one-row report has the expected values."""
    row = report.head().asDict()
    wrong = {k: (row[k], v) for k, v in expected.items() if row[k] != v}
    if wrong:
        raise CheckFailed(f"found and expected: {wrong}")


def uniqueness(df: DataFrame, *keys: str) -> DataFrame:
    """Rows, distinct keys, and surplus rows."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys")
    ).withColumn("surplus_rows", F.col("n_rows") - F.col("n_keys"))


def duplicated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def lost_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys missing afterwards, and keys that came from nowhere."""
    a = before.select(key, F.lit(1).alias("_b"), F.lit(0).alias("_a"))
    b = after.select(key, F.lit(0).alias("_b"), F.lit(1).alias("_a"))
    sides = a.unionByName(b).groupBy(key).agg(F.max("_b").alias("_b"), F.max("_a").alias("_a"))
    return sides.agg(
        F.count_if((F.col("_b") == 1) & (F.col("_a") == 0)).alias("lost"),
        F.count_if((F.col("_b") == 0) & (F.col("_a") == 1)).alias("added"),
    )


def null_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Number of nulls per column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])


def row_count(df: DataFrame, expected: int | None = None) -> DataFrame:
    """Row count, and whether it is the expected one."""
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return counted if expected is None else counted.withColumn("as_expected", F.col("n_rows") == expected)


def unknown_values(df: DataFrame, col: str, dictionary: DataFrame, key: str = "value") -> DataFrame:
    """Distinct values the dictionary lacks, with their row counts."""
    found = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return found.join(dictionary.select(F.col(key).alias(col)), col, "left_anti")


def score_quality(df: DataFrame, score: str) -> DataFrame:
    """Counts of scores that are missing, not finite, negative or above one."""
    s = F.col(score).cast("double")
    nan = F.isnan(s)
    infinite = s.isin(float("inf"), float("-inf"))
    bad = s.isNull() | nan | infinite | (s < 0) | (s > 1)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(s.isNull()).alias("missing"),
        F.count_if(nan).alias("not_a_number"),
        F.count_if(infinite).alias("infinite"),
        F.count_if((s < 0) & ~infinite).alias("below_zero"),
        F.count_if((s > 1) & ~nan & ~infinite).alias("above_one"),
        F.count_if(bad).alias("bad_rows"),
    )


def differing_rows(left: DataFrame, right: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Keys whose values differ or which one side lacks (null-safe)."""
    a = left.select(F.col(key), *[F.col(c).alias(f"{c}_left") for c in cols], F.lit(1).alias("_l"))
    b = right.select(F.col(key), *[F.col(c).alias(f"{c}_right") for c in cols], F.lit(1).alias("_r"))
    joined = a.join(b, key, "full")
    same = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    for c in cols:
        same = same & F.col(f"{c}_left").eqNullSafe(F.col(f"{c}_right"))
    return joined.where(~same).drop("_l", "_r")


def probabilities_sum_to_one(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose class probabilities are outside [0, 1] or do not add to one."""
    total = sum((F.col(c).cast("double") for c in cols), F.lit(0.0))
    bad_sum = F.abs(total - 1) > ATOL + RTOL
    outside = F.greatest(*[(F.col(c) < 0) | (F.col(c) > 1) for c in cols])
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(bad_sum).alias("bad_sums"),
        F.count_if(outside).alias("outside_range"),
    )


def alignment(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """How many keys match, and how many only one side has."""
    from .joins import aligned

    return aligned(left, right, on).agg(
        F.count_if("is_aligned").alias("aligned"), F.count_if(~F.col("is_aligned")).alias("misaligned")
    )
