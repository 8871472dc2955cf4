"""Features of texts and blocks, graphs, scaling, reduction and quantisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import tokens
from ..operators import graph_vectors, graphs, reduce, textfeatures, wide_reduction, wordvectors
from ..operators.entities import dictionary, entities
from ..operators.joins import star_features
from ..operators.pooling import explode_vector
from ..sources import tables as t
from ..sources.stage import materialize, new_path
from .encoding import BLOCK_FEATURES_SQL, STAR_SQL, WORDS_SQL, as_text, block_features
from .registry import query

W_ARRAY = "list_filter(regexp_split_to_array(text, '[ \\n\\r\\t]+'), lambda w: w <> '')"
HASH32 = "('0x' || substr(md5({}), 1, 8))::bigint"


def fingerprint_sql(table: str, key: str, bits: int = 2048) -> str:
    """Hashed counts of word runs of length one to three."""
    runs = """
        select {key}, w[i] as g from words union all
        select {key}, w[i] || ' ' || w[i + 1] from words where i + 1 <= n union all
        select {key}, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] from words where i + 2 <= n""".format(key=key)
    return f"""
        select {key}, ({HASH32.format('g')} % {bits})::int as bucket, count(*) as n from (
          with texts as (select {key}, {W_ARRAY} as w from {table}),
          words as (select {key}, w, len(w) as n, unnest(range(1, len(w) + 1)) as i from texts) {runs}) group by 1, 2"""


@query("f1_fingerprint", fingerprint_sql("documents", "doc_id"))
def fingerprint(spark, sf_dir):
    return textfeatures.fingerprint(t.texts(spark, sf_dir), "doc_id", "text")


@query("f1_fingerprint_dense", f"""
    with counts as ({fingerprint_sql("documents", "doc_id")}),
    slots as (select doc_id, b, len({W_ARRAY}) > 0 as usable from documents, range(2048) r(b)),
    filled as (select slots.doc_id, b, case when usable then coalesce(n, 0) else -1 end as n, usable
      from slots left join counts on slots.doc_id = counts.doc_id and bucket = b)
    select doc_id, md5(string_agg(case when usable then (n > 0)::int else -1 end::varchar, ',' order by b) || ',' ||
           string_agg(n::varchar, ',' order by b)) as fingerprint
    from filled group by 1""")
def fingerprint_dense(spark, sf_dir):
    """Presence bits and counts of every document in one list of twice the width, here as its md5."""
    dense = textfeatures.fingerprint_dense(t.texts(spark, sf_dir), "doc_id", "text")
    return dense.select("doc_id", F.md5(as_text("fingerprint")).alias("fingerprint"))


@query("f2_vocabulary", f"""
    select row_number() over (order by value) - 1 as idx, value from (
      select distinct {WORDS_SQL} as value from conversations)""")
def vocabulary(spark, sf_dir):
    """Every word of the conversations."""
    return textfeatures.vocabulary(t.table(spark, sf_dir, "conversations"), "text")


@query("f3_token_pools", f"""
    with v as (select row_number() over (order by value) - 1 as idx, value
               from (select distinct {WORDS_SQL} as value from documents)),
    w as (select doc_id, len({W_ARRAY}) as n, {WORDS_SQL} as value from documents)
    select doc_id, idx, round(count(*) / any_value(n), 6) as mean, 1 as max, count(*) as sum
    from w join v using (value) group by 1, 2""")
def token_pools(spark, sf_dir):
    docs = t.texts(spark, sf_dir)
    pools = textfeatures.token_pools(docs, "doc_id", "text", textfeatures.vocabulary(docs, "text"))
    return pools.withColumn("mean", F.round("mean", 6))


@query("f4_descriptors", f"""
    with d as (select doc_id, text, {W_ARRAY} as w, length(text) as c from documents)
    select doc_id, {', '.join(f"case when len(w) > 0 then {sql} else -1 end::double as {name}" for name, sql in {
        "n_chars": "c", "n_words": "len(w)", "n_distinct_words": "len(list_distinct(w))",
        "digit_share": "round(length(regexp_replace(text, '[^0-9]', '', 'g')) / c, 6)",
        "upper_share": "round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / c, 6)",
        "punctuation_share": "round(length(regexp_replace(text, '[^.,;:!?]', '', 'g')) / c, 6)",
        "words_per_char": "round(len(w) / c, 6)"}.items())} from d""")
def descriptors(spark, sf_dir):
    found = textfeatures.descriptors(t.texts(spark, sf_dir), "doc_id", "text")
    return found.select("doc_id", *[F.round(k, 6).alias(k) for k in found.columns if k != "doc_id"])


@query("f6_token_nodes", f"""
    select doc_id as graph, node, count(*) as occurrences, length(node)::int as width,
           regexp_matches(node, '^[A-Z]') as is_capital
    from (select doc_id, {WORDS_SQL} as node from documents) group by all""")
def token_nodes(spark, sf_dir):
    return graphs.token_nodes(t.texts(spark, sf_dir), "doc_id", "text")


EDGES_SQL = f"""
    select graph, least(a, b) as src, greatest(a, b) as dst, count(*) as weight,
           case when count(*) filter (a < b) > 0 and count(*) filter (a > b) > 0 then 'both'
                when count(*) filter (a < b) > 0 then 'forward' else 'reverse' end as edge_type
    from (select doc_id as graph, w[i] as a, w[i + 1] as b from (
            select doc_id, w, unnest(range(1, len(w))) as i from (select doc_id, {W_ARRAY} as w from documents)))
    where a <> b group by 1, 2, 3"""


@query("f6_token_edges", EDGES_SQL)
def token_edges(spark, sf_dir):
    return graphs.token_edges(t.texts(spark, sf_dir), "doc_id", "text")


@query("f6_relation_edges", """
    select l_suppkey as graph, l_orderkey as src, l_partkey as dst, l_returnflag as edge_type, count(*) as weight
    from lineitem group by 1, 2, 3, 4""")
def relation_edges(spark, sf_dir):
    """One graph per supplier: orders and parts are nodes, the flag types the edge."""
    return graphs.relation_edges(t.table(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey", "l_partkey", "l_returnflag")


def wl_sql(edges: str, nodes: str) -> str:
    """Degrees of all nodes and two refinement rounds."""

    def one_round(i: int) -> str:
        label = "('0x' || substr(md5(l.label || '_' || coalesce(hi, 0) || '_' || coalesce(lo, 0)), 1, 15))::bigint"
        return f"""
        l{i} as (select l.graph, l.node, {label} as label from l{i - 1} l left join (
          select d.graph, d.src as node, sum(o.label >> 30)::bigint as hi, sum(o.label & 1073741823)::bigint as lo
          from directed d join l{i - 1} o on d.graph = o.graph and d.dst = o.node group by 1, 2) s
          on l.graph = s.graph and l.node = s.node)"""

    return f"""
    with e as ({edges}), directed as (select graph, src, dst from e union all select graph, dst, src from e),
    deg as (select graph, src as node, count(*) as d from directed group by 1, 2),
    l0 as (select n.graph, n.node, ('0x' || substr(md5(coalesce(d, 0)::varchar), 1, 15))::bigint as label
           from ({nodes}) n left join deg on n.graph = deg.graph and n.node = deg.node), {one_round(1)}, {one_round(2)}
    select graph, round, label, count(*) as n from (
      select 0 as round, * from l0 union all select 1, * from l1 union all select 2, * from l2) group by 1, 2, 3"""


WORD_GRAPH_SQL = wl_sql(EDGES_SQL, f"select distinct doc_id as graph, {WORDS_SQL} as node from documents")


@query("f7_wl_labels", WORD_GRAPH_SQL)
def wl_labels(spark, sf_dir):
    """The graph of a text is refined within its row."""
    return graphs.text_wl_labels(t.texts(spark, sf_dir), "doc_id", "text")


RELATION_SQL = "select l_suppkey as graph, l_orderkey as src, l_partkey as dst, l_returnflag from lineitem group by all"


@query("f7_relation_labels", wl_sql(RELATION_SQL, "select distinct graph, src as node from directed"))
def relation_labels(spark, sf_dir):
    """Graphs of a relation, of any size, are refined by joins."""
    return graphs.wl_labels(relation_edges(spark, sf_dir))


@query("f7_hashed_counts", f"select graph, (label % 64)::int as bucket, sum(n)::bigint as n from ({WORD_GRAPH_SQL}) group by 1, 2")
def hashed_label_counts(spark, sf_dir):
    """What the embeddings are reduced from."""
    counts = graphs.hashed_counts(graphs.text_wl_labels(t.texts(spark, sf_dir), "doc_id", "text"), 64)
    return explode_vector(counts, ["graph"], "counts").where("value > 0").select(
        "graph", F.col("pos").cast("int").alias("bucket"), F.col("value").cast("bigint").alias("n"))


@query("f7_graph_embeddings")
def graph_embeddings(spark, sf_dir):
    """One reduced vector per document."""
    docs = t.texts(spark, sf_dir)
    return graphs.graph_embeddings(graphs.text_wl_labels(docs, "doc_id", "text"), docs.select(F.col("doc_id").alias("graph")))


@query("f7_trained_vectors")
def trained_graph_vectors(spark, sf_dir):
    """One vector per document, trained against the labels of its word graph."""
    docs = t.texts(spark, sf_dir)
    model = graph_vectors.fit_graph_vectors(graphs.text_wl_labels(docs, "doc_id", "text"))
    return model.vectors(docs.select(F.col("doc_id").alias("graph")))


@query("f8_concat_features", f"""
    select idx, array_to_string(list_concat(features, [length(value) - len(string_split(value, 'e')) + 1,
           (value like 'Brand%')::int, (value = upper(value))::int]), ',') as features from ({BLOCK_FEATURES_SQL})""",
    "obs dict")
def concat_features(spark, sf_dir):
    """Several feature lists of a block in one, with a width check."""
    v = F.col("value")
    rest = block_features(dictionary(spark, sf_dir)).withColumns({
        "no_e": F.array(F.length(F.regexp_replace(v, "e", ""))),
        "is_brand": F.array(v.startswith("Brand").cast("int")), "is_upper": F.array((v == F.upper(v)).cast("int"))})
    joined = reduce.combine_features(rest, ["features", "no_e", "is_brand", "is_upper"], width=7, out="all_features")
    return joined.select("idx", as_text("all_features").alias("features"))


VALUES_SQL = "select vec_id, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as v from embeddings"


@query("f9_standardise", f"""
    with e as ({VALUES_SQL}), s as (select pos, avg(v) as m, stddev_pop(v) as d from e group by 1)
    select vec_id, pos::int as pos, round((v - m) / d, 5) as value from e join s using (pos)""")
def standardise(spark, sf_dir):
    scaled = reduce.standardise(t.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    return explode_vector(scaled, ["vec_id"], "embedding").withColumn("value", F.round("value", 5))


@query("s11_saved_transformer", f"""
    with e as ({VALUES_SQL}), s as (select pos, avg(v) as m, stddev_pop(v) as d from e group by 1)
    select vec_id, pos::int as pos, round((v - m) / d, 5) as value from e join s using (pos)""")
def saved_transformer(spark, sf_dir):
    """A fitted scaler is saved, reloaded and applied."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.functions import vector_to_array

    from ..sources.stage import load_or_fit

    rows = reduce.as_vector(t.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    width = rows.select(F.size("embedding")).head()[0]
    stages = reduce.scaler(rows.count(), width, "_x", "_scaled")
    model = load_or_fit(spark, new_path(spark, "scaler"), PipelineModel, lambda: Pipeline(stages=stages).fit(rows))
    scaled = model.transform(rows).select("vec_id", vector_to_array("_scaled").alias("v"))
    return explode_vector(scaled, ["vec_id"], "v").withColumn("value", F.round("value", 5))


@query("p10_scale_to_int8", """
    with s as (select 127 / max(list_max(list_transform(embedding, lambda x: abs(x::double)))) as k from embeddings)
    select vec_id, array_to_string(list_transform(embedding, lambda x:
           least(greatest(trunc(x::double * k), -128), 127)::int), ',') as quantised from embeddings, s""")
def scale_to_int8(spark, sf_dir):
    """Scaled so that the largest absolute value becomes 127."""
    rows = t.table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", as_text(reduce.quantise("embedding", reduce.full_scale(rows, "embedding"))).alias("quantised"))


@query("f10_normalise", f"""
    with e as (select vec_id, pos, v + pos / 100.0::double as v from ({VALUES_SQL})),
    n as (select vec_id, sqrt(sum(v * v)) as n from e group by 1)
    select vec_id, pos::int as pos, round(v / n, 6) as value from e join n using (vec_id)""")
def normalise(spark, sf_dir):
    """The stored vectors have length one already, so they are shifted first."""
    shifted = F.transform("embedding", lambda x, i: x.cast("double") + i / F.lit(100.0))
    rows = t.table(spark, sf_dir, "embeddings").select("vec_id", reduce.normalise(shifted).alias("unit"))
    return explode_vector(rows, ["vec_id"], "unit").withColumn("value", F.round("value", 6))


@query("f11_reduction")
def reduction(spark, sf_dir):
    """Scaled, normalised and reduced vectors; the component count follows the cutoff."""
    rows = t.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fitted = reduce.fit_reduction(rows, "embedding", cutoff=0.9)
    return fitted.transform(rows, "embedding").select(
        "vec_id", "reduced", F.lit(fitted.components).alias("components"), F.lit(fitted.explained).alias("explained"))


@query("f11_wide_reduction")
def wide(spark, sf_dir):
    """The same by passes over the rows, as for lists too wide for a covariance matrix."""
    rows = t.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fitted = wide_reduction.fit_wide_reduction(rows, "embedding", cutoff=0.9)
    return fitted.transform(rows, "embedding").select(
        "vec_id", "reduced", F.lit(fitted.components).alias("components"), F.lit(fitted.explained).alias("explained"))


@query("f12_apply_fitted")
def apply_fitted(spark, sf_dir):
    """Fit on one half, save, reload, apply to the other half."""
    from pyspark.ml import PipelineModel

    from ..operators.neighbours import split_half
    from ..sources.stage import load_or_fit

    train, test = split_half(t.table(spark, sf_dir, "embeddings"), "vec_id", seed=12)
    path = new_path(spark, "reduction")
    model = load_or_fit(spark, path, PipelineModel, lambda: reduce.fit_reduction(train, "embedding", 0.9).model)
    from pyspark.ml.functions import vector_to_array

    return model.transform(reduce.as_vector(test, "embedding")).select("vec_id", vector_to_array("_pca").alias("reduced"))


@query("q1_quantise", """
    select vec_id, array_to_string(list_transform(embedding, lambda x:
           least(greatest(trunc(x::double * 1000), -128), 127)::int), ',') as quantised from embeddings""")
def quantise(spark, sf_dir):
    rows = t.table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", as_text(reduce.quantise("embedding", 1000.0)).alias("quantised"))


@query("q1_quantise_wrap", """
    select vec_id, array_to_string(list_transform(embedding, lambda x:
           (((trunc(x::double * 1000)::bigint + 128) % 256 + 256) % 256 - 128)::int), ',') as quantised from embeddings""")
def quantise_wrap(spark, sf_dir):
    """The low byte, for output that must match stored overflowed features."""
    rows = t.table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", as_text(reduce.quantise("embedding", 1000.0, "wrap")).alias("quantised"))


@query("q2_quantisation_error", f"""
    with e as ({VALUES_SQL}), s as (select 127 / max(abs(v)) as s from e),
    r as (select abs(v - least(greatest(trunc(v * s), -128), 127) / s) as err from e, s)
    select round(max(err), 6) as max_error, round(avg(err), 6) as mean_error from r""")
def quantisation_error(spark, sf_dir):
    """With the scale that uses the whole range."""
    rows = t.table(spark, sf_dir, "embeddings")
    errors = reduce.quantisation_error(rows, "embedding", reduce.full_scale(rows, "embedding"))
    return errors.select(F.round("max_error", 6).alias("max_error"), F.round("mean_error", 6).alias("mean_error"))


@query("f13_entity_features", f"select * from (with feat as ({BLOCK_FEATURES_SQL}) {STAR_SQL})", "obs dict ent")
def entity_features(spark, sf_dir):
    """Entity features stored by key and read back."""
    blocks = dictionary(spark, sf_dir)
    rows = star_features(entities(spark, sf_dir, blocks), block_features(blocks), t.BLOCK_IDS, ["entity_id"])
    return materialize(rows, "entity-features").select("entity_id", as_text().alias("features"))


@query("f5_sentence_vectors")
def sentence_vectors(spark, sf_dir):
    """Vectors of 300 numbers, fitted on all texts; mean, max and sum per text."""
    docs = t.texts(spark, sf_dir)
    return wordvectors.sentence_vectors(docs, "doc_id", "text", wordvectors.fit_word_vectors(docs, "text"))


@query("f2_word_counts", f"select doc_id, len({W_ARRAY})::int as words from documents")
def word_counts(spark, sf_dir):
    """Words per text, the length the pools divide by."""
    return t.table(spark, sf_dir, "documents").select("doc_id", F.size(tokens("text")).alias("words"))
