"""One row per entity and back, and grouping into sub-tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables as t
from ..sources.stage import materialize
from .keys import build_dictionary, distinct_values, encode
from .windows import dense_index


def consolidate(
    df: DataFrame, entity: str, group: str, label: str, groups: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    """Long to wide: one row per entity with one boolean per listed group.

    One shuffle with partial aggregation. ``carry`` columns depend on the entity
    and should be numbers (string minima would force a sort-based aggregate).
    """
    flags = [
        F.coalesce(F.max(F.when(F.col(group) == g, F.col(label).cast("int"))), F.lit(0)).__eq__(1).alias(
            f"label_{g.lower()}"
        )
        for g in groups
    ]
    return df.groupBy(entity).agg(*[F.min(c).alias(c) for c in carry], *flags)


def long_form(df: DataFrame, keys: Sequence[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    """Wide to long: one row per key and group; ``columns`` maps group to column."""
    pairs = F.array(
        *[F.struct(F.lit(g).alias(name), F.col(c).alias(value)) for g, c in columns.items()]
    )
    return df.select(*keys, F.inline(pairs))


def numbered_observations(spark, sf_dir: str, *cols: str) -> DataFrame:
    """Some columns of the observations with a dense ``id`` in row order.

    Only these and the order columns are shuffled, and only these are written.
    """
    rows = t.observations(spark, sf_dir, t.ROW_ORDER).select(*cols, *t.ROW_ORDER)
    return dense_index(rows, t.ROW_ORDER, "id", keep=cols)


def dictionary(spark, sf_dir: str) -> DataFrame:
    """The shared dictionary of all block strings of the observations."""
    return build_dictionary(distinct_values(t.observations(spark, sf_dir), t.BLOCKS))


def entities(spark, sf_dir: str, blocks: DataFrame | None = None) -> DataFrame:
    """One row per entity: three block ids and three labels.

    Labels are reduced per entity before anything is joined, so the joins see one
    row per entity rather than one per observation. The table is written: what uses
    it, often several times, starts from the copy.
    """
    blocks = dictionary(spark, sf_dir) if blocks is None else blocks
    items = t.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("entity_id"), F.col("l_returnflag").alias("grp"), t.label_rule().alias("label")
    )
    wide = consolidate(items, "entity_id", "grp", "label", t.GROUPS)
    parts = t.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("entity_id"),
        F.col("p_name").alias("b1"), F.col("p_brand").alias("b2"), F.col("p_type").alias("b3"),
    )
    encoded = encode(wide.join(parts, "entity_id"), blocks, dict(zip(t.BLOCKS, t.BLOCK_IDS)))
    return materialize(encoded.select("entity_id", *t.BLOCK_IDS, *t.LABELS), "entities")
