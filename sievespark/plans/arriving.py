"""Incremental queries; each must equal its batch counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.entities import dictionary
from ..operators.keys import encode
from ..sources import tables as t
from ..sources.stage import new_path
from ..streaming import incremental as inc
from .registry import query


@query("t1_running_dictionary", "select p_name as value from part union select p_brand from part union select p_type from part")
def running_dictionary(spark, sf_dir):
    out = new_path(spark, "stream-dictionary")
    stream = inc.arriving(spark, sf_dir, "part")
    inc.finish(inc.running_dictionary(stream, ["p_name", "p_brand", "p_type"], out, new_path(spark, "stream-state")))
    return spark.read.schema("value string").parquet(out)


@query("t1_stable_ids", """
    select value, row_number() over (order by value) - 1 as id
    from (select p_name as value from part union select p_brand from part union select p_type from part)""")
def stable_ids(spark, sf_dir):
    """Ids that stay when more files arrive; what one batch brings is numbered in its order."""
    out = new_path(spark, "stream-ids")
    stream = inc.arriving(spark, sf_dir, "part")
    inc.finish(inc.stable_ids(stream, ["p_name", "p_brand", "p_type"], out, new_path(spark, "stream-state")))
    return inc.ids_of(spark, out).select("value", "id")


@query("t2_running_counts", """
    select l_returnflag as grp, l_linestatus as status, count(*) as n from lineitem group by 1, 2""")
def running_counts(spark, sf_dir):
    out = new_path(spark, "stream-counts")
    stream = inc.arriving(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("status"))
    inc.finish(inc.running_counts(stream, ["grp", "status"], out, new_path(spark, "stream-state")))
    return inc.latest_counts(spark, out).select("grp", "status", "n")


@query("t3_group_sink", """
    select o.entity, o.grp, o.label, d1.idx as b1_idx, d2.idx as b2_idx, d3.idx as b3_idx
    from obs o join dict d1 on b1 = d1.value join dict d2 on b2 = d2.value join dict d3 on b3 = d3.value""", "obs dict")
def group_sink(spark, sf_dir):
    """Encode every batch of raw rows and add it to the folder of its group."""
    blocks = dictionary(spark, sf_dir)
    parts = t.table(spark, sf_dir, "part")
    out = new_path(spark, "stream-groups")

    def encode_batch(batch):
        rows = batch.join(parts, batch.l_partkey == parts.p_partkey).select(
            F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("grp"), t.label_rule().alias("label"),
            F.col("p_name").alias("b1"), F.col("p_brand").alias("b2"), F.col("p_type").alias("b3"))
        return encode(rows, blocks, dict(zip(t.BLOCKS, t.BLOCK_IDS)))

    stream = inc.arriving(spark, sf_dir, "lineitem")
    inc.finish(inc.per_group_sink(stream, encode_batch, "grp", out, new_path(spark, "stream-state")))
    return spark.read.parquet(out).select("entity", "grp", "label", *t.BLOCK_IDS)
