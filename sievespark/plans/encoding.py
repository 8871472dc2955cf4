"""Dictionary encoding, joins, aggregation and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import checks, joins, keys, pooling, sampling
from ..operators.entities import consolidate, dictionary, entities, numbered_observations
from ..operators.hash_tree import HashTrees
from ..operators.splits import hold_out, novel_share, tag_shared
from ..sources import tables as t
from ..sources.stage import materialize
from .registry import query

WORDS_SQL = "unnest(list_filter(regexp_split_to_array(text, '[ \\n\\r\\t]+'), lambda w: w <> ''))"

# Integer features of a block string; small enough to state in SQL.
BLOCK_FEATURES_SQL = """
    select idx, value, [length(value), length(regexp_replace(value, '[^0-9]', '', 'g')),
                 length(regexp_replace(value, '[^aeiou]', '', 'g')), length(value) - length(replace(value, ' ', ''))]
           as features from dict"""


def block_features(blocks):
    """The dictionary with four integer features per string, written once."""
    v = F.col("value")
    feats = F.array(
        F.length(v), F.length(F.regexp_replace(v, "[^0-9]", "")), F.length(F.regexp_replace(v, "[^aeiou]", "")),
        F.length(v) - F.length(F.replace(v, F.lit(" "), F.lit(""))),
    )
    return materialize(blocks.select("idx", "value", feats.alias("features")), "block-features")


def as_text(col="features"):
    """An integer list as text, so that lists compare across engines."""
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


@query("k1_distinct_values", "select distinct value from (select b1 as value from obs union all select b2 from obs "
       "union all select b3 from obs)", "obs")
def distinct_values(spark, sf_dir):
    return keys.distinct_values(t.observations(spark, sf_dir), t.BLOCKS)


@query("k2_dictionary", "from dict", "obs dict")
def shared_dictionary(spark, sf_dir):
    """Dictionaries of two datasets merged: rows of one line status each."""
    rows = t.observations(spark, sf_dir, ["l_linestatus"])
    halves = [keys.distinct_values(rows.where(cond), t.BLOCKS)
              for cond in (F.col("l_linestatus") == "O", F.col("l_linestatus") != "O")]
    return keys.build_dictionary(*halves)


@query("k3_dense_index", f"""
    select row_number() over (order by value) - 1 as idx, value
    from (select distinct {WORDS_SQL} as value from documents)""")
def dense_index(spark, sf_dir):
    """Ids for all words of all documents: a dictionary that grows with the data."""
    return keys.build_dictionary(c.explode_words(t.texts(spark, sf_dir), "text", name="value"))


@query("k5_entity_ids", """
    select row_number() over (order by b1, b2, b3) - 1 as entity_id, b1, b2, b3
    from (select distinct b1, b2, b3 from obs)""", "obs")
def entity_ids(spark, sf_dir):
    """Distinct rows of the three group tables, numbered."""
    rows = t.observations(spark, sf_dir)
    tables = [rows.where(F.col("grp") == g).select(*t.BLOCKS) for g in t.GROUPS]
    return keys.entity_ids(tables, t.BLOCKS)


@query("k6_bridge", """
    select o.id, e.entity_id from obs o left join (
      select row_number() over (order by b1, b2, b3) - 1 as entity_id, b1, b2, b3
      from (select distinct b1, b2, b3 from obs)) e using (b1, b2, b3)""", "obs")
def bridge(spark, sf_dir):
    rows = numbered_observations(spark, sf_dir, *t.BLOCKS)
    found = keys.entity_ids([rows.select(*t.BLOCKS)], t.BLOCKS)
    linked = materialize(keys.bridge(rows, found, t.BLOCKS, ["id"]), "bridge")
    checks.require(checks.null_counts(linked, "entity_id"), null_entity_id=0)
    return linked


@query("k7_decode", "select p_partkey as entity, p_name as b1, p_brand as b2, p_type as b3 from part")
def decode(spark, sf_dir):
    """Encoding and decoding give the strings back."""
    parts = t.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("entity"), F.col("p_name").alias("b1"), F.col("p_brand").alias("b2"),
        F.col("p_type").alias("b3"))
    blocks = keys.build_dictionary(keys.distinct_values(parts, t.BLOCKS))
    coded = keys.encode(parts, blocks, dict(zip(t.BLOCKS, t.BLOCK_IDS)))
    return keys.decode(coded, blocks, dict(zip(t.BLOCK_IDS, t.BLOCKS)))


@query("j1_inner_join", """
    select o_orderkey, c_mktsegment, o_totalprice from orders join customer on o_custkey = c_custkey""")
def inner_join(spark, sf_dir):
    o, cust = t.table(spark, sf_dir, "orders"), t.table(spark, sf_dir, "customer")
    return o.join(cust, o.o_custkey == cust.c_custkey).select("o_orderkey", "c_mktsegment", "o_totalprice")


STAR_SQL = """
    select entity_id, array_to_string(list_concat(list_concat(f1.features, f2.features), f3.features), ',') as features
    from ent join feat f1 on b1_idx = f1.idx join feat f2 on b2_idx = f2.idx join feat f3 on b3_idx = f3.idx"""


@query("j2_star_features", f"select * from (with feat as ({BLOCK_FEATURES_SQL}) {STAR_SQL})", "obs dict ent")
def star_features(spark, sf_dir):
    blocks = dictionary(spark, sf_dir)
    rows = joins.star_features(entities(spark, sf_dir, blocks), block_features(blocks), t.BLOCK_IDS, ["entity_id"])
    return rows.select("entity_id", as_text().alias("features"))


@query("j2_separate_features", f"""
    select * from (with feat as ({BLOCK_FEATURES_SQL})
    select entity_id, array_to_string(f1.features, ',') as features1, array_to_string(f2.features, ',') as features2,
           array_to_string(f3.features, ',') as features3
    from ent join feat f1 on b1_idx = f1.idx join feat f2 on b2_idx = f2.idx join feat f3 on b3_idx = f3.idx)""",
    "obs dict ent")
def separate_features(spark, sf_dir):
    """One list per block, as models with one input per block take them."""
    blocks = dictionary(spark, sf_dir)
    rows = joins.star_features(
        entities(spark, sf_dir, blocks), block_features(blocks), t.BLOCK_IDS, ["entity_id"], concat=False)
    return rows.select("entity_id", *[as_text(f"features{i}").alias(f"features{i}") for i in (1, 2, 3)])


@query("j2b_melt_features", f"select * from (with feat as ({BLOCK_FEATURES_SQL}) {STAR_SQL})", "obs dict ent")
def melt_features(spark, sf_dir):
    blocks = dictionary(spark, sf_dir)
    rows = joins.melt_features(entities(spark, sf_dir, blocks), block_features(blocks), "entity_id", t.BLOCK_IDS)
    return rows.select("entity_id", as_text().alias("features"))


@query("j3_left_join_complete", """
    select d.doc_id, l.quality, l.doc_id is not null as has_label from documents d left join labels l using (doc_id)""")
def left_join_complete(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(t.table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", "quality", F.col("quality").isNotNull().alias("has_label"))


@query("j4_anti_each", """
    select entity_id from ent where b1_idx not in (from held) and b2_idx not in (from held)
    and b3_idx not in (from held)""", "obs dict ent held")
def anti_each(spark, sf_dir):
    blocks = dictionary(spark, sf_dir)
    held = hold_out(blocks)[0].where("held").select("idx")
    return joins.anti_each(entities(spark, sf_dir, blocks), held, t.BLOCK_IDS, "idx").select("entity_id")


@query("j5_semi_any", """
    select entity_id, b1_idx, b2_idx, b3_idx from ent where b1_idx in (from held) or b2_idx in (from held)
    or b3_idx in (from held)""", "obs dict ent held")
def semi_any(spark, sf_dir):
    blocks = dictionary(spark, sf_dir)
    held = hold_out(blocks)[0].where("held").select("idx")
    return joins.semi_any(entities(spark, sf_dir, blocks), held, t.BLOCK_IDS, "idx").select("entity_id", *t.BLOCK_IDS)


ALIGN_SQL = """
    (select l_partkey as entity, max(case when l_quantity >= 45 and l_discount >= 0.095 then 1 else 0 end)::int as label
     from lineitem where l_returnflag = '{}' group by 1)"""


def group_labels(spark, sf_dir, group):
    """One label per entity, from the rows of one group."""
    rows = t.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == group)
    return rows.groupBy(F.col("l_partkey").alias("entity")).agg(F.max(t.label_rule()).alias("label"))


@query("j6_aligned_join", f"""
    select entity, a.label as label_a, r.label as label_r, a.label is not null and r.label is not null as is_aligned
    from {ALIGN_SQL.format('A')} a full join {ALIGN_SQL.format('R')} r using (entity)""")
def aligned_join(spark, sf_dir):
    left, right = (group_labels(spark, sf_dir, g).withColumnRenamed("label", f"label_{g.lower()}") for g in "AR")
    return joins.aligned(left, right, ["entity"])


@query("a1_distinct_rows", "select distinct l_partkey, l_suppkey from lineitem")
def distinct_rows(spark, sf_dir):
    return t.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("a2_class_share", "select count(*) as n_rows, sum(label)::bigint as positives, round(avg(label), 6) as share, "
       "grp from obs group by grp", "obs")
def class_share(spark, sf_dir):
    return t.observations(spark, sf_dir).groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("positives"), F.round(F.avg("label"), 6).alias("share"))


@query("a3_novel_share", f"""
    with d as (select distinct {WORDS_SQL} as word from documents), b as (select distinct {WORDS_SQL} as word from benchmark)
    select count(*) as distinct_values, round(avg((b.word is null)::int), 6) as novel_share
    from d left join b on d.word = b.word""")
def overlap_share(spark, sf_dir):
    """Share of document words the benchmark lacks."""
    docs = c.explode_words(t.texts(spark, sf_dir), "text", name="w")
    known = c.explode_words(t.table(spark, sf_dir, "benchmark"), "text")
    return novel_share(docs, known, ["w"], "word")


@query("a4_frequency_table", "select l_suppkey as value, count(*) as n from lineitem group by 1 order by 2 desc, 1")
def frequency_table(spark, sf_dir):
    """A table has few distinct values compared with rows; it is ordered after counting."""
    counted = sampling.counts_by(t.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("value")), "value")
    return counted.orderBy(F.desc("n"), "value")


POOL_SQL = """
    with e as (select label, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as v from embeddings),
    p as (select label, pos, avg(v) as mean, max(v) as max, sum(v) as sum from e group by all)
    select label, pos::int as pos, round(mean, 6) as value from p
    union all select label, (pos + 64)::int, round(max, 6) from p
    union all select label, (pos + 128)::int, round(sum, 6) from p"""


@query("a5_pools", POOL_SQL)
def pools(spark, sf_dir):
    """Mean, maximum and sum of the vectors of each class, in one list."""
    pooled = pooling.pool_vectors(t.table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    long = pooling.explode_vector(pooled, ["label"], "pooled")
    return long.withColumn("value", F.round("value", 6))


@query("a6_sum_pool", """
    select label, pos::int as pos, round(sum(v), 6) as value from (
      select label, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as v from embeddings)
    group by all""")
def sum_pool(spark, sf_dir):
    long = pooling.explode_vector(t.table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return pooling.pool_long(long.withColumn("value", F.col("value").cast("double")), ["label"], "pos", "value").select(
        "label", "pos", F.round("sum", 6).alias("value"))


@query("a9_macro_mean", """
    select count(*) as n_groups, round(avg(m), 6) as macro_mean from (
      select l_returnflag, l_linestatus, avg(l_discount) as m from lineitem group by all)""")
def macro_mean(spark, sf_dir):
    """Mean of group means."""
    per = t.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("m"))
    return per.agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.avg("m"), 6).alias("macro_mean"))


@query("e1_consolidate", "from ent", "obs dict ent")
def consolidated(spark, sf_dir):
    return entities(spark, sf_dir)


@query("e1_consolidate_any", """
    select o_custkey, min(o_orderkey) as first_order, coalesce(max(case when o_orderstatus = 'F' then flag end), 0) = 1
           as label_f, coalesce(max(case when o_orderstatus = 'O' then flag end), 0) = 1 as label_o,
           coalesce(max(case when o_orderstatus = 'P' then flag end), 0) = 1 as label_p
    from (select *, (o_totalprice > 200000)::int as flag from orders) group by 1""")
def consolidate_any(spark, sf_dir):
    """The same reshaping on another table: customers by order status."""
    rows = t.table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderstatus", F.col("o_orderkey").alias("first_order"),
        (F.col("o_totalprice") > 200000).alias("flag"))
    return consolidate(rows, "o_custkey", "o_orderstatus", "flag", ["F", "O", "P"], carry=["first_order"])


@query("c1_uniqueness", """
    select sum(n)::bigint as n_rows, count(*) as n_keys, sum(n)::bigint - count(*) as surplus_rows
    from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)""")
def uniqueness(spark, sf_dir):
    return checks.uniqueness(t.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("c1_duplicated_keys", """
    select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1""")
def duplicated_keys(spark, sf_dir):
    return checks.duplicated_keys(t.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("c2_lost_rows", """
    select (select count(*) from documents where doc_id not in (select doc_id from labels)) as lost,
           (select count(*) from labels where doc_id not in (select doc_id from documents)) as added""")
def lost_rows(spark, sf_dir):
    return checks.lost_rows(t.table(spark, sf_dir, "documents"), t.table(spark, sf_dir, "labels"), "doc_id")


@query("c3_null_counts", """
    select count(*) filter (quality is null) as null_quality, count(*) filter (toxic is null) as null_toxic
    from documents left join labels using (doc_id)""")
def null_counts(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select("doc_id")
    return checks.null_counts(docs.join(t.table(spark, sf_dir, "labels"), "doc_id", "left"), "quality", "toxic")


@query("c4_row_count", "select count(*) as n_rows, count(*) = (select count(*) from part) as as_expected from ent",
       "obs dict ent")
def expected_row_count(spark, sf_dir):
    return checks.row_count(entities(spark, sf_dir), t.table(spark, sf_dir, "part").count())


@query("c5_unknown_values", f"""
    select word, count(*) as n from (select {WORDS_SQL} as word from documents)
    where word not in (select {WORDS_SQL} from benchmark) group by 1""")
def unknown_values(spark, sf_dir):
    """Document words outside the closed dictionary of benchmark words."""
    docs = c.explode_words(t.texts(spark, sf_dir), "text")
    known = c.explode_words(t.table(spark, sf_dir, "benchmark"), "text", name="value").distinct()
    return checks.unknown_values(docs, "word", known)


@query("c6_score_quality", """
    select count(*) as n_rows, 0::bigint as missing, 0::bigint as not_a_number, 0::bigint as infinite,
           count(*) filter (v < 0) as below_zero, count(*) filter (v > 1) as above_one,
           count(*) filter (v < 0 or v > 1) as bad_rows from (select value / 50 - 0.1::double as v from events)""")
def score_quality(spark, sf_dir):
    rows = t.table(spark, sf_dir, "events").select((F.col("value") / 50 - F.lit(0.1)).alias("v"))
    return checks.score_quality(rows, "v")


DIFFERING_SQL = """
    select coalesce(a.entity, r.entity) as entity, a.label as label_left, r.label as label_right
    from """ + ALIGN_SQL.format("A") + " a full join " + ALIGN_SQL.format("R") + """ r on a.entity = r.entity
    where a.entity is null or r.entity is null or a.label is distinct from r.label"""


@query("c7_differing_rows", DIFFERING_SQL)
def differing_rows(spark, sf_dir):
    return checks.differing_rows(group_labels(spark, sf_dir, "A"), group_labels(spark, sf_dir, "R"), "entity", ["label"])


@query("c7_hash_tree", DIFFERING_SQL)
def hash_tree_rows(spark, sf_dir):
    """The same for written tables too large to join whole: only rows of leaves that differ are joined."""
    sides = [materialize(group_labels(spark, sf_dir, g), "side") for g in ("A", "R")]
    return HashTrees(*sides, "entity", ["label"]).differing_rows()


@query("c8_probabilities", """
    select count(*) as n_rows, count(*) filter (abs(a + b + c - 1) > 1e-8 + 1e-5) as bad_sums,
           count(*) filter (a < 0 or a > 1 or b < 0 or b > 1 or c < 0 or c > 1) as outside_range
    from (select l_discount as a, l_tax as b, 0.95 - l_discount::double as c from lineitem)""")
def probabilities(spark, sf_dir):
    rows = t.table(spark, sf_dir, "lineitem").select(
        F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), (F.lit(0.95) - F.col("l_discount")).alias("c"))
    return checks.probabilities_sum_to_one(rows, ["a", "b", "c"])


@query("c9_alignment", f"""
    select count(*) filter (ok) as aligned, count(*) filter (not ok) as misaligned from (
      select a.label is not null and r.label is not null as ok
      from {ALIGN_SQL.format('A')} a full join {ALIGN_SQL.format('R')} r using (entity))""")
def alignment(spark, sf_dir):
    return checks.alignment(group_labels(spark, sf_dir, "A"), group_labels(spark, sf_dir, "R"), ["entity"])


@query("p6_membership", """
    select entity_id from ent where b1_idx in (from held) or b2_idx in (from held) or b3_idx in (from held)""",
    "obs dict ent held")
def membership(spark, sf_dir):
    blocks = dictionary(spark, sf_dir)
    held = hold_out(blocks)[0].where("held").select("idx")
    return joins.semi_any(entities(spark, sf_dir, blocks), held, t.BLOCK_IDS, "idx").select("entity_id")


@query("p7_conditional_label", """
    select entity_id, case when split = 'val' then 'nonshared' else 'shared' end as split_group from tagged""",
    "obs dict ent held tagged")
def conditional_label(spark, sf_dir):
    blocks = dictionary(spark, sf_dir)
    held = hold_out(blocks)[0].where("held").select("idx")
    return tag_shared(entities(spark, sf_dir, blocks), t.BLOCK_IDS, held).select("entity_id", "split_group")
