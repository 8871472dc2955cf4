"""Metrics, ensembling, and the final scored output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import checks, metrics, scoring
from ..sources import tables as t
from .encoding import BLOCK_FEATURES_SQL, block_features
from .registry import query

# Two deterministic scores per entity, so that joins of scores can be stated in SQL.
SCORES_SQL = """scores as (
    select entity_id, (('0x' || substr(md5(entity_id::varchar || '|1'), 1, 8))::bigint % 1000) / 1000.0::double as s1,
           (('0x' || substr(md5(entity_id::varchar || '|2'), 1, 8))::bigint % 1000) / 1000.0::double as s2 from ent)"""

LEVELS = """lv as (select {by}, score, sum(label) as tp, count(*) as n from scored group by {by}, score),
    rk as (select *, sum(tp) over w as ctp, sum(n) over w as cn from lv
           window w as (partition by {by} order by score desc))"""


def hash_score(key, seed):
    """A reproducible score in [0, 1) with three digits."""
    return (c.hash_number(c.key_hash(key, seed=seed)) % 1000) / F.lit(1000.0)


@query("x1_average_precision", f"""
    select * from (with {LEVELS.format(by='grp, split_group')}
    select grp, split_group, round(coalesce(sum(tp * ctp / cn) / nullif(sum(tp), 0), 0), 6) as ap from rk group by 1, 2)""",
    "scored")
def average_precision(spark, sf_dir):
    """Per group and split group; combinations that do not occur are absent."""
    ap = metrics.average_precision(t.scored(spark, sf_dir), ["grp", "split_group"])
    return ap.withColumn("ap", F.round("ap", 6))


@query("x2_mean_average_precision", f"""
    select round(avg(ap), 6) as mean_ap from (with {LEVELS.format(by='grp, split_group')}
    select grp, split_group, coalesce(sum(tp * ctp / cn) / nullif(sum(tp), 0), 0) as ap from rk group by 1, 2)""", "scored")
def mean_average_precision(spark, sf_dir):
    """Ranked by the scores as they are."""
    out = metrics.mean_average_precision(t.scored(spark, sf_dir), ["grp", "split_group"])
    return out.withColumn("mean_ap", F.round("mean_ap", 6))


@query("x3_classification", """
    select grp, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision,
           round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall,
           round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1
    from (select grp, count(*) filter (score > 0.5 and label = 1) as tp, count(*) filter (score > 0.5 and label = 0) as fp,
                 count(*) filter (score <= 0.5 and label = 1) as fn from scored group by 1)""", "scored")
def classification(spark, sf_dir):
    out = metrics.classification(t.scored(spark, sf_dir), ["grp"])
    return out.select("grp", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")])


@query("x4_auc_gini", f"""
    select grp, round(auc, 6) as auc, round(2 * auc - 1, 6) as gini from (with {LEVELS.format(by='grp')}
    select grp, sum((n - tp) * (ctp - tp / 2)) / nullif(sum(tp) * sum(n - tp), 0) as auc from rk group by 1)""", "scored")
def auc_gini(spark, sf_dir):
    """Undefined, so null, for a group with one class only."""
    out = metrics.roc_auc(t.scored(spark, sf_dir), ["grp"])
    return out.select("grp", F.round("auc", 6).alias("auc"), F.round("gini", 6).alias("gini"))


@query("x5_roc_points", f"""
    select * from (with {LEVELS.format(by='grp')}
    select grp, score as threshold, round((cn - ctp) / nullif(sum(n - tp) over (partition by grp), 0), 6) as fpr,
           round(ctp / nullif(sum(tp) over (partition by grp), 0), 6) as tpr from rk)""", "scored")
def roc_points(spark, sf_dir):
    out = metrics.roc_points(t.scored(spark, sf_dir), ["grp"])
    return out.select("grp", "threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


BCE = "avg(-(case when {y} = 1 then greatest(case when {p} <= 0 then -100 else ln({p}) end, -100) " \
      "else greatest(case when {p} >= 1 then -100 else ln(1 - {p}) end, -100) end))"


@query("x6_cross_entropy", f"""
    select grp, round(a, 6) as loss_label, round(b, 6) as loss_split_group, round(a + b, 6) as loss from (
      select grp, {BCE.format(y='label', p='score')} as a, {BCE.format(y='split_group', p='score')} as b
      from scored group by 1)""", "scored")
def cross_entropy(spark, sf_dir):
    """Two targets scored by one model output, summed."""
    out = metrics.cross_entropy(t.scored(spark, sf_dir), {"label": "score", "split_group": "score"}, ["grp"])
    names = ("loss_label", "loss_split_group", "loss")
    return out.select("grp", *[F.round(m, 6).alias(m) for m in names])


PAIRWISE = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] / 10.0::double - z[2] / 10.0::double + 1e-6) ^ 2)))"


@query("x7_contrastive_loss", f"""
    select round(avg((1 - y) * d * d + y * greatest(2 - d, 0) ^ 2), 5) as loss, round(avg(d), 5) as mean_distance
    from (with feat as ({BLOCK_FEATURES_SQL})
      select label_a::int as y, {PAIRWISE.format(a='f1.features', b='f2.features')}
        + {PAIRWISE.format(a='f1.features', b='f3.features')} + {PAIRWISE.format(a='f2.features', b='f3.features')} as d
      from ent join feat f1 on b1_idx = f1.idx join feat f2 on b2_idx = f2.idx join feat f3 on b3_idx = f3.idx)""",
    "obs dict ent")
def contrastive_loss(spark, sf_dir):
    """Over the three block vectors of each entity."""
    from ..operators.entities import dictionary, entities
    from ..operators.joins import star_features

    blocks = dictionary(spark, sf_dir)
    rows = star_features(
        entities(spark, sf_dir, blocks), block_features(blocks), t.BLOCK_IDS, ["label_a"], concat=False)
    vectors = [F.transform(f"features{i}", lambda x: x / F.lit(10.0)).alias(f"v{i}") for i in (1, 2, 3)]
    out = metrics.contrastive_loss(rows.select("label_a", *vectors), ["v1", "v2", "v3"], "label_a")
    return out.select(F.round("loss", 5).alias("loss"), F.round("mean_distance", 5).alias("mean_distance"))


@query("x8_report", f"""
    select round_even(f1, 3) as f1, round_even(gini, 2) as gini, round_even(precision, 3) as precision,
           round_even(recall, 3) as recall, round_even(ap, 3) as average_precision
    from (with {LEVELS.format(by='a')} select 2 * sum((n - tp) * (ctp - tp / 2)) / (sum(tp) * sum(n - tp)) - 1 as gini,
                 sum(tp * ctp / cn) / sum(tp) as ap from rk),
         (select tp / (tp + fp) as precision, tp / (tp + fn) as recall, 2 * tp / (2 * tp + fp + fn) as f1
          from (select count(*) filter (score > 0.5 and label = 1) as tp,
                       count(*) filter (score > 0.5 and label = 0) as fp,
                       count(*) filter (score <= 0.5 and label = 1) as fn from scored))""".replace(
                           "from scored group by a, score", "from (select 1 as a, * from scored) group by a, score"),
    "scored")
def report(spark, sf_dir):
    return metrics.report(t.scored(spark, sf_dir))


@query("m6_ensemble", f"""
    select * from (with {SCORES_SQL} select entity_id, (s1 + s2) / 2 as score from scores)""", "obs dict ent")
def ensemble(spark, sf_dir):
    """Mean of two models' scores, joined by id."""
    from ..operators.entities import entities

    rows = entities(spark, sf_dir).select("entity_id")
    first, second = (rows.select("entity_id", hash_score("entity_id", k).alias("score")) for k in (1, 2))
    return scoring.average_scores(first, second, "entity_id", "score")


@query("m9_scored_output", f"""
    select * from (with {SCORES_SQL} select id, round_even(case grp when 'A' then s1 when 'N' then s2
      else (s1 + s2) / 2 end, 3) as score from obs join scores on entity = entity_id)""", "obs dict ent")
def scored_output(spark, sf_dir):
    """Scores by entity and group, joined to every observation, checked, rounded, sorted."""
    from ..operators.entities import entities, numbered_observations
    from ..sources.stage import materialize

    one, two = hash_score("entity_id", 1), hash_score("entity_id", 2)
    predicted = entities(spark, sf_dir).select(
        "entity_id", one.alias("score_a"), two.alias("score_n"), ((one + two) / 2).alias("score_r"))
    rows = numbered_observations(spark, sf_dir, "entity", "grp")
    wanted = rows.select("id", F.col("entity").alias("entity_id"), "grp")
    columns = dict(zip(t.GROUPS, ("score_a", "score_n", "score_r")))
    out = materialize(scoring.scored_output(wanted, predicted, columns), "scored-output")
    checks.require(checks.null_counts(out, "score"), null_score=0)
    checks.require(checks.row_count(out), n_rows=wanted.count())
    return out.orderBy("id")


@query("c6_scored_quality", """
    select count(*) as n_rows, count(*) filter (score is null) as missing, count(*) filter (isnan(score)) as not_a_number,
           count(*) filter (isinf(score)) as infinite, count(*) filter (score < 0) as below_zero,
           count(*) filter (score > 1) as above_one, 0::bigint as bad_rows from scored""", "scored")
def scored_quality(spark, sf_dir):
    return checks.score_quality(t.scored(spark, sf_dir), "score")
