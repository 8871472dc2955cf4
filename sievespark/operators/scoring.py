"""Combining scores and building the final output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import round_score


def average_scores(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """Mean of two models' scores, joined by id."""
    right = b.select(key, F.col(score).alias("_other"))
    return a.join(right, key).select(key, ((F.col(score) + F.col("_other")) / 2).alias(score))


def scored_output(rows: DataFrame, predicted: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rounded score of every (id, entity_id, grp) row; ``columns`` maps group to score.

    One left join by entity serves all groups: the wide scores are joined once
    and the group of the row picks its column, instead of one join per group.
    """
    wide = predicted.select("entity_id", *columns.values())
    pick = F.coalesce(*[F.when(F.col("grp") == g, F.col(col)) for g, col in columns.items()])
    return rows.join(wide, "entity_id", "left").select("id", round_score(pick).alias("score"))


def nearest_class(distances: DataFrame, key: str = "query_id") -> DataFrame:
    """1 where a row is closer to the positives than to the negatives."""
    return distances.withColumn("predicted", (F.col("positive_dist") < F.col("negative_dist")).cast("int"))
