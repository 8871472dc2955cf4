"""Order, sets, sampling, balancing and leakage-aware splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import sampling as s
from ..operators import splits, windows
from ..operators.entities import dictionary, entities, numbered_observations
from ..sources import tables as t
from .encoding import WORDS_SQL
from .registry import query

HASH = "md5({}::varchar || '|{}')"
POSITIVE = "(label_a or label_n or label_r)"


def held_split(spark, sf_dir, rule=splits.split_any, share=0.1):
    """Entities with their split, and the marked dictionary."""
    blocks = dictionary(spark, sf_dir)
    marked, cut = splits.hold_out(blocks, share)
    return rule(entities(spark, sf_dir, blocks), t.BLOCK_IDS, cut), marked


@query("w1_running_counts", """
    select grp, score, sum(sum(label)) over w::bigint as ctp, sum(count(*)) over w::bigint as cn
    from scored group by grp, score window w as (partition by grp order by score desc)""", "scored")
def running_counts(spark, sf_dir):
    from ..operators.metrics import ranking

    return ranking(t.scored(spark, sf_dir), ["grp"]).select("grp", "score", "ctp", "cn")


@query("w2_row_number", """
    select event_id, user_id, row_number() over (partition by user_id order by ts, event_id)::int as n from events""")
def row_number(spark, sf_dir):
    """Position of each event within its user; a user may have any number of events."""
    rows = t.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return windows.row_number_in(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("w3_row_ranges", """
    select o_orderkey, floor((row_number() over (order by o_orderkey) - 1)::double / count(*) over () * 7)::int as part
    from orders""")
def row_ranges(spark, sf_dir):
    return windows.row_ranges(t.table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query("o1_sort", "select p_partkey, p_size, p_retailprice from part order by p_size, p_partkey")
def sort(spark, sf_dir):
    return t.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice").orderBy("p_size", "p_partkey")


@query("o2_head", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def head(spark, sf_dir):
    rows = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("o3_permutation", f"""
    select row_number() over (order by {HASH.format('o_orderkey', 11)}) - 1 as position, o_orderkey from orders""")
def permutation(spark, sf_dir):
    return windows.permutation(t.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 11)


@query("u1_union_all", """
    select user_id as id, 'event' as kind from events union all select c_custkey, 'customer' from customer
    union all select doc_id, 'document' from documents""")
def union_all(spark, sf_dir):
    pairs = (("events", "user_id", "event"), ("customer", "c_custkey", "customer"), ("documents", "doc_id", "document"))
    return s.union_all(*[
        t.table(spark, sf_dir, n).select(F.col(k).alias("id"), F.lit(kind).alias("kind")) for n, k, kind in pairs])


@query("u2_difference", f"""
    select doc_id, word from (select doc_id, {WORDS_SQL} as word from documents)
    where word not in (select {WORDS_SQL} from benchmark)""")
def difference(spark, sf_dir):
    """Words the benchmark lacks; repeats are kept."""
    docs = c.explode_words(t.texts(spark, sf_dir), "text", "doc_id")
    known = c.explode_words(t.table(spark, sf_dir, "benchmark"), "text").distinct()
    return s.difference(docs, known, ["word"])


@query("u3_membership_share", f"""
    select doc_id, count(*) as words, round(avg((word in (select {WORDS_SQL} from benchmark))::int), 6) as known_share
    from (select doc_id, {WORDS_SQL} as word from documents) group by 1""")
def membership_share(spark, sf_dir):
    """Share of each document's words that the benchmark has.

    Counted per document and word before the join, so a frequent word meets the
    benchmark once per document.
    """
    known = c.explode_words(t.table(spark, sf_dir, "benchmark"), "text").distinct()
    per = c.word_counts(t.texts(spark, sf_dir), "doc_id", "text", "word", "n")
    flagged = per.join(known.withColumn("_known", F.lit(True)), "word", "left")
    hits = F.sum(F.when(F.col("_known"), F.col("n")).otherwise(0))
    return flagged.groupBy("doc_id").agg(
        F.sum("n").alias("words"), F.round(hits / F.sum("n"), 6).alias("known_share"))


@query("u3_intersection", "select o_orderkey, o_custkey from orders where o_custkey in "
       "(select c_custkey from customer where c_mktsegment = 'BUILDING')")
def intersection(spark, sf_dir):
    wanted = t.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return s.intersection(orders, wanted.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


@query("b1_undersample", f"""
    select entity_id, {POSITIVE} as positive from ent where {POSITIVE} or entity_id in (
      select entity_id from ent where not {POSITIVE} order by {HASH.format('entity_id', 7)}
      limit (select 9 * count(*) from ent where {POSITIVE}))""", "obs dict ent")
def undersample(spark, sf_dir):
    """All positives and nine times as many negatives, as far as they exist."""
    kept = s.undersample(entities(spark, sf_dir), c.any_true(t.LABELS), "entity_id", 9, seed=7)
    return kept.select("entity_id", c.any_true(t.LABELS).alias("positive"))


@query("b1_undersample_rows", f"""
    select id, label from obs where label = 1 or id in (
      select id from obs where label = 0 order by {HASH.format('id', 7)} limit (select 9 * sum(label) from obs))""",
    "obs")
def undersample_rows(spark, sf_dir):
    """On the rare positives of the raw rows the sample is a small share."""
    rows = numbered_observations(spark, sf_dir, "label")
    return s.undersample(rows, F.col("label") == 1, "id", 9, seed=7)


@query("b2_oversample", f"""
    select entity_id, {POSITIVE} as positive, case when {POSITIVE} then unnest(range(0, 1 + (
      select ceil(0.5::double / avg({POSITIVE}::int))::bigint from ent))) else 0 end::int as copy
    from ent where {POSITIVE}
    union all select entity_id, false, 0 from ent where not {POSITIVE}""", "obs dict ent")
def oversample(spark, sf_dir):
    rows = s.oversample(entities(spark, sf_dir), c.any_true(t.LABELS), 0.5)
    return rows.select("entity_id", c.any_true(t.LABELS).alias("positive"), "copy")


@query("b2_oversample_exact", f"""
    select n_rows, positives, round(positives / n_rows, 6) as share from (
      select n + greatest(0, ceil((0.4::double * n - p) / 0.6::double)::bigint) as n_rows,
             p + greatest(0, ceil((0.4::double * n - p) / 0.6::double)::bigint) as positives
      from (select count(*) as n, count(*) filter {"(" + POSITIVE + ")"} as p from ent))""".replace(
          "filter (" + POSITIVE + ")", "filter (where " + POSITIVE + ")"), "obs dict ent")
def oversample_exact(spark, sf_dir):
    rows = s.oversample_exact(entities(spark, sf_dir), c.any_true(t.LABELS), "entity_id", 0.4, seed=7)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(c.any_true(t.LABELS)).alias("positives")).withColumn(
        "share", F.round(F.col("positives") / F.col("n_rows"), 6))


@query("b3_class_ratio", f"""
    select doc_id, quality from labels where quality = 1 or doc_id in (
      select doc_id from labels where quality = 0 order by {HASH.format('doc_id', 3)}
      limit (select (sum(quality) // 8)::bigint from labels))""")
def class_ratio(spark, sf_dir):
    """Negatives are an eighth of the positives."""
    rows = t.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return s.class_ratio(rows, "quality", "doc_id", 8, seed=3)


@query("b4_exact_sample", f"select o_orderkey, o_custkey from orders order by {HASH.format('o_orderkey', 5)} limit 1000")
def exact_sample(spark, sf_dir):
    return s.sample_exact(t.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 1000, "o_orderkey", 5)


@query("b4_share_sample", f"""
    select event_id, user_id from (select *, row_number() over (order by {HASH.format('event_id', 5)}) as r, count(*) over () as n
    from events) where r <= n // 3""")
def share_sample(spark, sf_dir):
    """A sample that grows with the table: every third row."""
    rows = t.table(spark, sf_dir, "events").select("event_id", "user_id")
    return s.sample_exact(rows, rows.count() // 3, "event_id", 5)


@query("b5_quota_sample", f"""
    select event_id, event_type from (
      select event_id, event_type, row_number() over (partition by event_type order by {HASH.format('event_id', 9)}) as r,
             1000 // (select count(distinct event_type) from events) as quota from events) where r <= quota""")
def quota_sample(spark, sf_dir):
    rows = t.table(spark, sf_dir, "events").select("event_id", "event_type")
    return s.quota_sample(rows, "event_type", "event_id", 1000, seed=9)


@query("b6_group_sample", f"""
    select doc_id, source from documents where source in (
      select source from (select distinct source from documents) order by {HASH.format('source', 2)} limit 3)""")
def group_sample(spark, sf_dir):
    return s.sample_groups(t.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 3, seed=2)


@query("b7_random_split", f"""
    select o_orderkey, (('0x' || substr({HASH.format('o_orderkey', 4)}, 1, 8))::bigint % 25)::int as split_group from orders""")
def random_split(spark, sf_dir):
    return s.random_split(t.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 25, 4, "split_group")


@query("v1_hold_out", "select idx, value, idx in (from held) as held from dict", "obs dict held")
def hold_out(spark, sf_dir):
    return splits.hold_out(dictionary(spark, sf_dir))[0]


@query("v2_split_any", "select entity_id, split from tagged", "obs dict ent held tagged")
def split_any(spark, sf_dir):
    return held_split(spark, sf_dir)[0].select("entity_id", "split")


@query("v3_split_strict", f"""
    with h as (select idx from dict order by {HASH.format('idx', 253)} limit (select ceil(0.35::double * count(*))::bigint from dict)),
    m as (select entity_id, (b1_idx in (from h))::int + (b2_idx in (from h))::int + (b3_idx in (from h))::int as n from ent)
    select entity_id, case n when 3 then 'val' else 'train' end as split from m where n in (0, 3)""".replace(
        "with h as", "select * from (with h as", 1) + ")", "obs dict ent")
def split_strict(spark, sf_dir):
    """The strict rule needs a larger held-out share to leave any validation rows."""
    return held_split(spark, sf_dir, splits.split_strict, 0.35)[0].select("entity_id", "split")


@query("v4_split_report", """
    select split, entities, round(entities / sum(entities) over (partition by grp), 6) as share, grp, positives from (
      select split, count(*) as entities, 'A' as grp, sum(label_a::int)::bigint as positives from tagged group by 1
      union all select split, count(*), 'N', sum(label_n::int)::bigint from tagged group by 1
      union all select split, count(*), 'R', sum(label_r::int)::bigint from tagged group by 1)""",
    "obs dict ent held tagged")
def split_report(spark, sf_dir):
    """What share of entities and positives lands in validation when 10 % of blocks are held out."""
    return splits.split_report(held_split(spark, sf_dir)[0], t.LABELS, t.GROUPS)


@query("v4_novel_blocks", """
    select count(*) as distinct_values, round(avg((idx in (from held))::int), 6) as novel_share from (
      select b1_idx as idx from tagged where split = 'val' union select b2_idx from tagged where split = 'val'
      union select b3_idx from tagged where split = 'val')""", "obs dict ent held tagged")
def novel_blocks(spark, sf_dir):
    """Share of the blocks used in validation that training lacks."""
    rows, marked = held_split(spark, sf_dir)
    val = rows.where(F.col("split") == "val")
    return splits.novel_share(val, marked.where(~F.col("held")).select("idx"), t.BLOCK_IDS, "idx")


@query("v5_shared_tag", """
    select entity_id, case when b1_idx in (from held) or b2_idx in (from held) or b3_idx in (from held)
           then 'nonshared' else 'shared' end as split_group from tagged where split = 'val'""", "obs dict ent held tagged")
def shared_tag(spark, sf_dir):
    rows, marked = held_split(spark, sf_dir)
    val = rows.where(F.col("split") == "val")
    return splits.tag_shared(val, t.BLOCK_IDS, marked.where("held").select("idx")).select("entity_id", "split_group")
