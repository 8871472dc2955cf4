"""The whole way: block strings to features, models per group, final scores, report.

Five feature lists of every block string are put together, scaled, reduced to the
components that explain 0.9 of the variance, and stored as int8. Entities fetch the
features of their blocks; one model per group is fitted outside the held-out blocks;
every observation gets the score of its entity and group; the output is written and
read back.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import checks, graphs, metrics, models, reduce, scoring, textfeatures
from ..operators.entities import dictionary, entities, long_form, numbered_observations
from ..operators.joins import star_features
from ..operators.splits import hold_out, split_any
from ..sources import tables as t
from ..sources.stage import materialize, new_path
from .registry import query

CUTOFF = 0.9
GRAPH_WIDTH = 64
VECTOR_SIZE = 16
TARGETS = dict(zip(t.GROUPS, t.LABELS))


def screening_features(blocks):
    """(idx, features): the reduced int8 features of every block string."""
    rows = blocks.select(F.col("idx").alias("block"), "value")
    vocab = materialize(textfeatures.vocabulary(rows, "value"), "block-words")
    words = vocab.count()
    model = textfeatures.fit_word_vectors(rows, "value", size=VECTOR_SIZE)
    described = textfeatures.descriptors(rows, "block", "value")
    labels = graphs.hashed_counts(graphs.text_wl_labels(rows, "block", "value"), GRAPH_WIDTH)
    parts = {
        "fingerprint": (textfeatures.fingerprint_dense(rows, "block", "value"), 2 * textfeatures.FINGERPRINT_BITS),
        "pools": (textfeatures.token_pools_dense(rows, "block", "value", vocab, words), 3 * words),
        "descriptors": (
            described.select("block", F.array(*[c for c in described.columns if c != "block"]).alias("descriptors")),
            len(described.columns) - 1),
        "graph": (labels.select(F.col("graph").alias("block"), F.col("counts").alias("graph")), GRAPH_WIDTH),
        "vectors": (
            textfeatures.sentence_vectors(rows, "block", "value", model).select("block", F.col("features").alias("vectors")),
            3 * VECTOR_SIZE),
    }
    joined = rows
    for name, (part, width) in parts.items():
        unusable = F.array_repeat(F.lit(float(textfeatures.INVALID)), width)
        part = part.withColumn(name, F.col(name).cast("array<double>"))
        joined = joined.join(part, "block", "left").withColumn(name, F.coalesce(name, unusable))
    width = sum(w for _, w in parts.values())
    every = materialize(reduce.combine_features(joined, list(parts), width).select("block", "features"), "block-lists")
    kept = materialize(reduce.varying(every, "features"), "block-varying")
    reduced = materialize(reduce.fit_reduction(kept, "varying", CUTOFF).transform(kept, "varying"), "block-reduced")
    scale = reduce.full_scale(reduced, "reduced")
    return materialize(reduced.select(F.col("block").alias("idx"), reduce.quantise("reduced", scale).alias("features")), "screening-features")


def screening_table(spark, sf_dir):
    """Entities with the features of their blocks, labels and split."""
    blocks = dictionary(spark, sf_dir)
    _, cut = hold_out(blocks)
    split = split_any(entities(spark, sf_dir, blocks), t.BLOCK_IDS, cut)
    rows = star_features(split, screening_features(blocks), t.BLOCK_IDS, ["entity_id", *t.LABELS, "split"])
    return materialize(rows, "screening")


def screened(spark, sf_dir):
    """The modelling table with one score per group."""
    rows = screening_table(spark, sf_dir)
    fit = partial(models.fit_boosted, min_leaf=20, maxDepth=5, maxIter=5)
    train = rows.where(F.col("split") != "val")
    fitted = models.fit_targets(train, "features", TARGETS, fit)
    return materialize(models.score_targets(fitted, rows, "features", ["entity_id", "split", *t.LABELS]), "screened")


@query("z1_screening_features", "select idx, true as in_range, true as same_width from dict", "obs dict")
def features_of_blocks(spark, sf_dir):
    """Every block has its quantised features, all of one width and within int8."""
    found = screening_features(dictionary(spark, sf_dir))
    width = found.select(F.size("features")).head()[0]
    fits = F.forall("features", lambda x: x.between(-128, 127))
    return found.select("idx", fits.alias("in_range"), ((F.size("features") == width) & (F.size("features") > 0)).alias("same_width"))


@query("z2_screening_output", """
    select grp, count(*) as n_rows, count(distinct id) as n_ids, 0::bigint as bad_scores from obs group by 1""", "obs")
def output_of_screening(spark, sf_dir):
    """The final output, written, read back and held against the observations."""
    predicted = screened(spark, sf_dir)
    columns = {g: f"score_{g.lower()}" for g in t.GROUPS}
    wanted = numbered_observations(spark, sf_dir, "entity", "grp").withColumnRenamed("entity", "entity_id")
    out = scoring.scored_output(wanted, predicted, columns).orderBy("id")
    path = new_path(spark, "output")
    out.write.csv(path, header=True)
    back = spark.read.schema("id bigint, score double").csv(path, header=True)
    checks.require(checks.lost_rows(wanted, back, "id"), lost=0, added=0)
    bad = F.col("score").isNull() | ~F.col("score").between(0, 1)
    return back.join(wanted, "id").groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"), F.count_if(bad).alias("bad_scores"))


@query("z3_screening_report")
def report_of_screening(spark, sf_dir):
    """Average precision and AUC of the models on the held-out blocks and on the rest."""
    predicted = screened(spark, sf_dir)
    scores = long_form(predicted, ["entity_id", "split"], {g: f"score_{g.lower()}" for g in t.GROUPS}, "grp", "score")
    labels = long_form(predicted, ["entity_id"], TARGETS, "grp", "label")
    rows = materialize(scores.join(labels, ["entity_id", "grp"]).withColumn("label", F.col("label").cast("int")), "reported")
    ap = metrics.average_precision(rows, ["grp", "split"])
    return ap.join(metrics.roc_auc(rows, ["grp", "split"]), ["grp", "split"]).select("grp", "split", "ap", "auc")
