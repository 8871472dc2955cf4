"""Comparing two large tables by hash trees over their keys.

Rows are dealt to leaves by a hash of their key. A leaf's hash is the sum of its rows' hashes,
so it needs no order and is summed before the shuffle; a node's hash is the sum of its children's.
Both trees are compared from the root, and only below nodes that differ; what is joined in
the end are the rows of the leaves that differ. Two tables that are equal are
read once each, and none of their rows is shuffled.

Missing keys are in a leaf of their own kind (the hash of null) and, as in a join, are equal to none:
each of them is reported. Keys that occur several times meet each of the other side's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import materialize
from .checks import differing_rows

#: Children of a node; leaves are FANOUT ** levels, and hold about LEAF_ROWS rows.
FANOUT, LEAF_ROWS, MAX_LEVELS = 64, 4_096, 3
_PRIME = (1 << 61) - 1


def levels_for(rows: int) -> int:
    """Levels below the root at which leaves are small enough."""
    levels = 1
    while levels < MAX_LEVELS and FANOUT**levels * LEAF_ROWS < rows:
        levels += 1
    return levels


def leaf_of(key: str, levels: int):
    return F.pmod(F.xxhash64(F.lit("leaf"), key), F.lit(FANOUT**levels))


def leaf_hashes(rows: DataFrame, key: str, cols: Sequence[str], levels: int) -> DataFrame:
    """(leaf, n, h): rows and hash of every leaf that has a row."""
    # Two hashes that a null can't leave unchanged; sums of both are compared.
    plain = F.struct(F.col(key), *[F.struct(F.col(c).isNull(), F.col(c)) for c in cols])
    one = F.pmod(F.xxhash64(plain), F.lit(_PRIME)).cast("decimal(38,0)")
    two = F.pmod(F.xxhash64(F.lit("second"), plain), F.lit(_PRIME)).cast("decimal(38,0)")
    return rows.groupBy(leaf_of(key, levels).alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.sum(one).alias("h"), F.sum(two).alias("g"))


class HashTrees:
    """Both tables' trees; ``differing`` holds the leaves that differ, ``visited`` the nodes compared per level."""

    def __init__(self, left: DataFrame, right: DataFrame, key: str, cols: Sequence[str], levels: int | None = None):
        self.left, self.right, self.key, self.cols = left, right, key, list(cols)
        # Row counts come from file footers; they only set the size of the trees.
        self.levels = levels or levels_for(max(left.count(), right.count()))
        sides = [leaf_hashes(d, key, cols, self.levels).withColumn("side", F.lit(i)) for i, d in enumerate((left, right))]
        leaves = materialize(sides[0].union(sides[1]), "leaves")  # at most FANOUT ** MAX_LEVELS rows a side
        self.visited, below = [], None
        for level in range(self.levels + 1):
            width = FANOUT ** (self.levels - level)
            nodes = leaves.withColumn("node", F.floor(F.col("leaf") / width))
            if below is not None:
                nodes = nodes.join(below, F.floor(F.col("leaf") / (width * FANOUT)) == F.col("parent"), "left_semi")
            sums = nodes.groupBy("node").agg(*[
                F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(F.lit(0))).alias(f"{c}{s}") for c in ("n", "h", "g") for s in (0, 1)])
            sums = materialize(sums, "nodes")
            unlike = (F.col("n0") != F.col("n1")) | (F.col("h0") != F.col("h1")) | (F.col("g0") != F.col("g1"))
            self.visited.append(sums.count())
            below = sums.where(unlike).select(F.col("node").alias("parent"))
            if below.isEmpty():
                break
        self.differing = below.withColumnRenamed("parent", "leaf")

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """The rows of both tables in leaves that differ, or that have no key."""
        found = []
        for d in (self.left, self.right):
            at = d.withColumn("_leaf", leaf_of(self.key, self.levels))
            inside = at.join(self.differing, F.col("_leaf") == F.col("leaf"), "left_semi").where(F.col(self.key).isNotNull())
            found.append(inside.union(at.where(F.col(self.key).isNull())).drop("_leaf"))
        return found[0], found[1]

    def differing_rows(self) -> DataFrame:
        """Keys whose values differ or which one side lacks, as ``checks.differing_rows`` gives them."""
        return differing_rows(*self.candidates(), self.key, self.cols)
