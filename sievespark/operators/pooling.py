"""Pooling of vectors: mean, maximum and sum per position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pool_vectors(df: DataFrame, by: Sequence[str], vector: str, metrics: Sequence[str] = ("mean", "max", "sum")) -> DataFrame:
    """Pool a dense vector column per group; the pools follow one another in one list.

    The summary is an aggregate function with partial results: each task sends
    one small buffer per group, never the vectors of a group.
    """
    vec = array_to_vector(F.col(vector).cast("array<double>"))
    summary = Summarizer.metrics(*metrics).summary(vec)
    out = df.groupBy(*by).agg(summary.alias("_s"))
    return out.select(*by, F.concat(*[vector_to_array(f"_s.{m}") for m in metrics]).alias("pooled"))


def pool_long(df: DataFrame, by: Sequence[str], pos: str, value: str) -> DataFrame:
    """Pool vectors stored as (key, position, value) rows."""
    return df.groupBy(*by, pos).agg(
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.sum(value).alias("sum")
    )


def explode_vector(df: DataFrame, keep: Sequence[str], vector: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """One row per position of a vector."""
    return df.select(*keep, F.posexplode(vector).alias(pos, value))
