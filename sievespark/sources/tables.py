"""Declared schemas of the input tables and the roles the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import spread

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

GROUPS = ["A", "N", "R"]
BLOCKS = ["b1", "b2", "b3"]
BLOCK_IDS = ["b1_idx", "b2_idx", "b3_idx"]
LABELS = ["label_a", "label_n", "label_r"]
# A total order of the raw rows: the two key columns alone repeat.
ROW_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice",
]


def schema_of(name: str) -> T.StructType:
    """The declared schema of an input table."""
    return T.StructType.fromDDL(SCHEMAS[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one input table with its declared schema (no inference job)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """Key and whole text of a table, on as many tasks as there are cores."""
    return spread(table(spark, sf_dir, name).select(key, "text"))


def label_rule() -> F.Column:
    """1 for the rare positive rows, else 0."""
    return F.when((F.col("l_quantity") >= 45) & (F.col("l_discount") >= 0.095), 1).otherwise(0)


def observations(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    """Raw rows: an entity, its three building blocks, a target group and a label."""
    items = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    return items.join(parts, items.l_partkey == parts.p_partkey).select(
        F.col("l_partkey").alias("entity"),
        F.col("p_name").alias("b1"),
        F.col("p_brand").alias("b2"),
        F.col("p_type").alias("b3"),
        F.col("l_returnflag").alias("grp"),
        label_rule().alias("label"),
        *(keep or []),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled scores with a group and a split group, for the metrics."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("grp"),
        F.col("toxic").alias("split_group"),
        F.col("quality").alias("label"),
        ((F.col("n_chars") % 50) / F.lit(50.0)).alias("score"),
    )
