"""Scans, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import checks, sampling
from ..operators.entities import dictionary, entities, long_form
from ..operators.keys import encode
from ..operators.windows import dense_index
from ..sources import tables as t
from ..sources.stage import new_path, run_stage
from .registry import query


@query("s1_full_scan", """
    select vec_id, label, len(embedding)::int as width,
           round(list_sum(list_transform(embedding, lambda x: x::double)), 6) as total from embeddings""")
def full_scan(spark, sf_dir):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return t.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.size("embedding").alias("width"), F.round(total, 6).alias("total")
    )


@query("s2_pruned_scan", "select o_orderkey, o_custkey, o_orderpriority from orders")
def pruned_scan(spark, sf_dir):
    return t.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")


@query("s3_filtered_scan", """
    select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_returnflag = 'R'""")
def filtered_scan(spark, sf_dir):
    rows = t.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("s4_limited_scan", "select event_id, user_id, event_type from events order by event_id limit 100")
def limited_scan(spark, sf_dir):
    rows = t.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return rows.orderBy("event_id").limit(100)


@query("s5_partitioned_scan", """
    select l_returnflag as grp, count(*) as n_rows, count(distinct l_partkey) as entities from lineitem group by 1""")
def partitioned_scan(spark, sf_dir):
    """What a batched read with running state computes, over ordinary partitions.

    Entities are deduplicated per task first; a group is never one task's work.
    """
    per = t.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(F.col("l_returnflag").alias("grp")).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("entities")
    )


@query("s6_row_count", "select count(*) as n_rows from lineitem")
def row_count(spark, sf_dir):
    return checks.row_count(t.table(spark, sf_dir, "lineitem"))


@query("s7_pattern_scan", """
    select l_returnflag as grp, count(*) as n_rows, sum(l_quantity) as quantity from lineitem
    where l_returnflag in ('A', 'R') group by 1""")
def pattern_scan(spark, sf_dir):
    """Write one folder per group, then read the folders a name pattern selects."""
    path = new_path(spark, "by-group")
    rows = t.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_quantity")
    rows.write.partitionBy("grp").parquet(path)
    found = spark.read.option("basePath", path).parquet(f"{path}/grp=[AR]")
    return found.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("quantity"))


@query("s8_round_trip", "select p_partkey, p_name, p_size, p_retailprice from part")
def round_trip(spark, sf_dir):
    path = new_path(spark, "round-trip")
    rows = t.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query("s9_group_sink", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_returnflag = 'N'""")
def group_sink(spark, sf_dir):
    """One output folder per group; reading one group touches only its files."""
    path = new_path(spark, "group-sink")
    rows = t.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("grp")
    )
    rows.write.partitionBy("grp").parquet(path)
    return spark.read.parquet(path).where(F.col("grp") == "N").drop("grp")


@query("s10_stage_skip", "select p_partkey, p_size * 2 as doubled from part where p_size > 10")
def stage_skip(spark, sf_dir):
    """A stage is built once; running it again returns what is stored."""
    path = new_path(spark, "stage")
    rows = t.table(spark, sf_dir, "part").where(F.col("p_size") > 10)
    run_stage(spark, path, lambda: rows.select("p_partkey", (F.col("p_size") * 2).alias("doubled")))
    return run_stage(spark, path, lambda: rows.select("p_partkey", F.lit(0).alias("doubled")))


@query("p1_select_rename", "select c_custkey as entity_id, c_mktsegment as grp from customer")
def select_rename(spark, sf_dir):
    rows = t.table(spark, sf_dir, "customer").drop("c_name", "c_acctbal", "c_nationkey")
    return rows.withColumnsRenamed({"c_custkey": "entity_id", "c_mktsegment": "grp"})


@query("p2_narrowing_cast", """
    select l_orderkey, try_cast(l_quantity as tinyint) as small_quantity,
           try_cast(l_extendedprice as smallint) as small_price,
           try_cast(l_extendedprice as smallint) is null as overflowed from lineitem""")
def narrowing_cast(spark, sf_dir):
    """Casts that give null where the value does not fit; fractions are rounded half to even first."""
    whole = {k: F.bround(k, 0) for k in ("l_quantity", "l_extendedprice")}
    price = whole["l_extendedprice"].try_cast("smallint")
    return t.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", whole["l_quantity"].try_cast("tinyint").alias("small_quantity"),
        price.alias("small_price"), price.isNull().alias("overflowed"),
    )


@query("p3_default_label", "select doc_id, lang, 0 as label from documents")
def default_label(spark, sf_dir):
    return c.with_default(t.table(spark, sf_dir, "documents").select("doc_id", "lang"), "label", 0)


@query("p4_conjunction", """
    select l_orderkey, l_linenumber, l_suppkey from lineitem
    where l_returnflag = 'A' and l_linestatus = 'O' and l_quantity = 30""")
def conjunction(spark, sf_dir):
    rows = t.table(spark, sf_dir, "lineitem")
    wanted = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O") & (F.col("l_quantity") == 30)
    return rows.where(wanted).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("p5_any_label", "select entity_id, label_a or label_n or label_r as positive from ent", "obs dict ent")
def any_label(spark, sf_dir):
    """The filter and its negation, side by side."""
    rows = entities(spark, sf_dir)
    positive = c.any_true(t.LABELS)
    return sampling.union_all(
        rows.where(positive).select("entity_id", F.lit(True).alias("positive")),
        rows.where(~positive).select("entity_id", F.lit(False).alias("positive")),
    )


@query("p8_threshold", "select id, (score > 0.5)::int as predicted from scored", "scored")
def threshold(spark, sf_dir):
    return t.scored(spark, sf_dir).select("id", c.to_class("score").alias("predicted"))


@query("p9_half_even_round", "select p_partkey, round_even(p_retailprice / 16, 3) as rounded from part")
def half_even_round(spark, sf_dir):
    rows = t.table(spark, sf_dir, "part")
    return rows.select("p_partkey", c.round_score(F.col("p_retailprice") / 16).alias("rounded"))


@query("p11_flatten", """
    select doc_id, pos::int as pos, word from (
      select doc_id, generate_subscripts(w, 1) - 1 as pos, unnest(w) as word from (
        select doc_id, flatten(list_transform(string_split(text, chr(10)),
               lambda l: list_filter(string_split(l, ' '), lambda x: x <> ''))) as w from documents))""")
def flatten(spark, sf_dir):
    """Lines to words to one flat list of words per document."""
    lines = F.transform(F.split("text", "\n"), lambda l: F.filter(F.split(l, " "), lambda w: w != ""))
    flat = t.table(spark, sf_dir, "documents").select("doc_id", F.flatten(lines).alias("words"))
    return flat.select("doc_id", F.posexplode_outer("words").alias("pos", "word")).where(F.col("pos").isNotNull())


@query("p12_zero_pad", """
    select p_partkey, case when length(p_partkey::varchar) >= 3 then p_partkey::varchar
                           else lpad(p_partkey::varchar, 3, '0') end as tag from part""")
def zero_pad(spark, sf_dir):
    return t.table(spark, sf_dir, "part").select("p_partkey", c.zero_pad("p_partkey", 3).alias("tag"))


@query("p13_regex", """
    select p_partkey, coalesce(regexp_matches(p_name, '^(red|blue) .*t$'), false) as hit,
           regexp_extract(p_brand, '#([0-9]+)', 1) as brand_no from part""")
def regex(spark, sf_dir):
    return t.table(spark, sf_dir, "part").select(
        "p_partkey", c.matches("p_name", "^(red|blue) .*t$").alias("hit"),
        F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("brand_no"),
    )


@query("p13b_regex_values", "select p_partkey, p_name from part where regexp_matches(p_name, 'o[lt]')")
def regex_values(spark, sf_dir):
    return t.table(spark, sf_dir, "part").where(c.matches("p_name", "o[lt]")).select("p_partkey", "p_name")


@query("p14_trim", """
    select conv_id, turn, trim(text) as trimmed, length(trim(text))::int as width from conversations""")
def trim(spark, sf_dir):
    trimmed = F.trim("text")
    return t.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", trimmed.alias("trimmed"), F.length(trimmed).alias("width")
    )


@query("p15_output_tag", """
    select o_orderkey, 'run-' || strftime(o_orderdate, '%Y%m%d') || '-' ||
           case when v >= 100 then v::varchar else lpad(v::varchar, 3, '0') end as tag
    from (select *, (o_orderkey % 101)::int as v from orders)""")
def output_tag(spark, sf_dir):
    score = ((F.col("o_orderkey") % 101) + 0.5) / 100.0
    return t.table(spark, sf_dir, "orders").select("o_orderkey", c.output_tag("run", F.col("o_orderdate"), score).alias("tag"))


@query("p16_one_hot_group", """
    select l_orderkey, l_linenumber, l_quantity, (l_returnflag = 'A')::int as "is_A",
           (l_returnflag = 'N')::int as "is_N", (l_returnflag = 'R')::int as "is_R" from lineitem""")
def one_hot_group(spark, sf_dir):
    return t.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", *c.one_hot("l_returnflag", t.GROUPS)
    )


@query("e2_wide_to_long", """
    select entity_id, 'A' as grp, label_a as label from ent union all
    select entity_id, 'N', label_n from ent union all select entity_id, 'R', label_r from ent""", "obs dict ent")
def wide_to_long(spark, sf_dir):
    rows = entities(spark, sf_dir)
    return long_form(rows, ["entity_id"], dict(zip(t.GROUPS, t.LABELS)), "grp", "label")


@query("e3_sub_tables", """
    select 'train' as split, entity_id from tagged where split = 'train'
    union all select 'val', entity_id from tagged where split = 'val'""", "obs dict ent held tagged")
def sub_tables(spark, sf_dir):
    """Named sub-tables: one written table partitioned by the name."""
    from ..operators.splits import hold_out, split_any

    blocks = dictionary(spark, sf_dir)
    _, cut = hold_out(blocks)
    path = new_path(spark, "sub-tables")
    split_any(entities(spark, sf_dir, blocks), t.BLOCK_IDS, cut).write.partitionBy("split").parquet(path)
    names = ("train", "val")
    return sampling.union_all(
        *[spark.read.parquet(path).where(F.col("split") == n).select("split", "entity_id") for n in names]
    )


@query("k4_encode", """
    select o.id, o.grp, o.label, d1.idx as b1_idx, d2.idx as b2_idx, d3.idx as b3_idx
    from obs o join dict d1 on b1 = d1.value join dict d2 on b2 = d2.value join dict d3 on b3 = d3.value""",
    "obs dict")
def encode_blocks(spark, sf_dir):
    """Strings are replaced first, so numbering sorts narrow rows."""
    blocks = dictionary(spark, sf_dir)
    rows = t.observations(spark, sf_dir, t.ROW_ORDER)
    coded = encode(rows, blocks, dict(zip(t.BLOCKS, t.BLOCK_IDS)))
    return dense_index(coded, t.ROW_ORDER, "id", keep=["grp", "label", *t.BLOCK_IDS])
