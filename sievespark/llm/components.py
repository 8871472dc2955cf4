"""Connected components as Spark jobs over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) of the nodes in ``edges`` (``a``, ``b``).

    Alternating large and small stars: every round hangs the neighbours of a node on
    the smallest of them, which needs a minimum per node (summed before the shuffle)
    and a join, and shortens paths by half or more. Rounds are written to the shared
    folder. Loops and repeated edges are allowed; nodes with loops only are absent.
    """
    at = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = _state(at)
    while state[0]:
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(at)
        if state == before:
            break
    return at.select(F.col("u").alias("node"), F.col("v").alias("label")).union(at.select("v", "v").distinct())
