"""Dictionary encoding: distinct values, dense ids, and replacement by ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import dense_index


def distinct_values(df: DataFrame, cols: Sequence[str], name: str = "value") -> DataFrame:
    """Distinct non-null values over several columns; deduplicated before the shuffle."""
    return df.select(F.explode(F.array(*cols)).alias(name)).where(F.col(name).isNotNull()).distinct()


def build_dictionary(*values: DataFrame, name: str = "value") -> DataFrame:
    """Merge value lists into one dictionary with dense 0-based ids in value order."""
    merged = values[0].select(name)
    for more in values[1:]:
        merged = merged.unionByName(more.select(name))
    return dense_index(merged.distinct(), [name]).select("idx", name)


def encode(
    df: DataFrame, dictionary: DataFrame, columns: dict[str, str], how: str = "inner", key: str = "value"
) -> DataFrame:
    """Replace string columns by dictionary ids (``columns`` maps input to output).

    The dictionary is a written table, so Spark knows its size and broadcasts it
    only while it is small; a large one is joined by shuffle, where adaptive
    execution splits the partitions of frequent values.
    """
    for source, target in columns.items():
        ids = dictionary.select(F.col("idx").alias(target), F.col(key).alias("_key"))
        df = df.join(ids, F.col(source) == F.col("_key"), how).drop("_key", source)
    return df


def decode(df: DataFrame, dictionary: DataFrame, columns: dict[str, str], key: str = "value") -> DataFrame:
    """Replace id columns by their strings."""
    for source, target in columns.items():
        names = dictionary.select(F.col("idx").alias("_key"), F.col(key).alias(target))
        df = df.join(names, F.col(source) == F.col("_key")).drop("_key", source)
    return df


def entity_ids(tables: Sequence[DataFrame], keys: Sequence[str | Column], name: str = "entity_id") -> DataFrame:
    """Distinct rows of several tables, numbered."""
    merged = tables[0]
    for more in tables[1:]:
        merged = merged.unionByName(more)
    return dense_index(merged.distinct(), keys, name)


def bridge(rows: DataFrame, entities: DataFrame, on: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Observation id to entity id. Left join: unknown entities stay, with null."""
    return rows.join(entities.select(*on, "entity_id"), list(on), "left").select(*keep, "entity_id")
