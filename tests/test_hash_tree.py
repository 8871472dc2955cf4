"""Comparison by hash trees equals the full join, and reads only what differs."""

import pytest
from conftest import values
from pyspark.sql import functions as F

from sievespark.operators import hash_tree
from sievespark.operators.checks import differing_rows
from sievespark.operators.hash_tree import HashTrees


def pair(spark, n=20_000):
    left = spark.range(n).select("id", (F.col("id") % 7).alias("v"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), F.col("id"))).alias("t"))
    return left, left.repartition(3)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("levels", [1, 2, None])
def test_equals_the_full_join(spark, levels):
    left, right = pair(spark)
    extra = spark.createDataFrame([(50_000, 1, "new"), (None, 2, "no key"), (17, 3, "17 again")], "id bigint, v bigint, t string")
    right = right.where("id not in (5, 600)").withColumn("v", F.when(F.col("id").isin(77, 9_000), 100).otherwise(F.col("v"))).withColumn(
        "t", F.when(F.col("id") == 10, "not null").when(F.col("id") == 11, None).otherwise(F.col("t"))).unionByName(extra)
    left = left.unionByName(extra.where("id is null"))
    trees = HashTrees(left, right, "id", ["v", "t"], levels)
    assert rows(trees.differing_rows()) == rows(differing_rows(left, right, "id", ["v", "t"]))
    a, b = trees.candidates()
    if levels == 2:
        # Nine keys differ: the rows of at most nine of 4,096 leaves are joined.
        assert trees.differing.count() <= 9 and a.count() + b.count() < 9 * 30
        assert trees.visited[0] == 1 and trees.visited[2] <= 9 * hash_tree.FANOUT


def test_equal_ranges_are_not_joined(spark):
    left, right = pair(spark)
    trees = HashTrees(left, right, "id", ["v", "t"])
    assert trees.visited == [1] and trees.differing.isEmpty()
    a, b = trees.candidates()
    assert a.count() == b.count() == 0 and trees.differing_rows().isEmpty()
    empty = HashTrees(left.limit(0), right.limit(0), "id", ["v"])
    assert empty.differing_rows().isEmpty()
    one = HashTrees(left, right.limit(0), "id", ["v"])
    assert one.differing_rows().count() == 20_000


def test_levels_follow_the_rows():
    assert [hash_tree.levels_for(n) for n in (0, 200_000, 10**7, 10**12)] == [1, 1, 2, 3]
