"""Ranking and classification metrics per group, as aggregates.

Rows are first reduced to one per group and distinct score, so tied scores are
one step of the ranking. Running totals over those levels give every curve. Pass
``digits`` to round scores first: a group then has a bounded number of levels and
a plain window suffices; without it a group may span many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CLASS_THRESHOLD, ratio, round_score

LOG_FLOOR = -100.0  # fixed value: the floor of logarithms in the cross-entropy
MARGIN = 2.0  # fixed value: the margin of the contrastive loss
DISTANCE_EPS = 1e-6  # fixed value: added to differences before the pairwise norm


def ranking(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score", digits: int | None = None
) -> DataFrame:
    """Per group and distinct score, downwards: positives, rows, running totals."""
    from .windows import running_totals

    level = F.col(score) if digits is None else round_score(score, digits)
    levels = df.groupBy(*by, level.alias(score)).agg(
        F.sum(F.col(label).cast("bigint")).alias("tp"), F.count(F.lit(1)).alias("n")
    )
    return running_totals(levels, by, [F.col(score).desc()], {"tp": "ctp", "n": "cn"}, bounded=digits is not None)


def average_precision(df: DataFrame, by: Sequence[str], digits: int | None = None, **cols) -> DataFrame:
    """Average precision per group; 0 for a group without positives."""
    gain = F.sum(F.col("tp") * F.col("ctp") / F.col("cn"))
    return ranking(df, by, digits=digits, **cols).groupBy(*by).agg(ratio(gain, F.sum("tp")).alias("ap"))


def mean_average_precision(df: DataFrame, by: Sequence[str], digits: int | None = None, **cols) -> DataFrame:
    """Plain mean over the groups that occur."""
    return average_precision(df, by, digits, **cols).agg(F.avg("ap").alias("mean_ap"))


def area(fp: Column) -> Column:
    """Area under the ROC curve from ranked levels (null with one class only)."""
    gained = F.sum(fp * (F.col("ctp") - F.col("tp") / 2.0))
    return F.try_divide(gained, F.sum("tp") * F.sum(fp).cast("double"))


def roc_auc(df: DataFrame, by: Sequence[str] = (), digits: int | None = None, **cols) -> DataFrame:
    """Area under the ROC curve and Gini per group (null with one class only)."""
    auc = area(F.col("n") - F.col("tp"))
    out = ranking(df, by, digits=digits, **cols).groupBy(*by).agg(auc.alias("auc"))
    return out.withColumn("gini", F.col("auc") * 2 - 1)


def roc_points(df: DataFrame, by: Sequence[str] = (), digits: int | None = None, **cols) -> DataFrame:
    """False and true positive rate at every distinct score."""
    keys = list(by) or ["_all"]
    ranked = ranking(df if by else df.withColumn("_all", F.lit(1)), keys, digits=digits, **cols)
    totals = ranked.groupBy(*keys).agg(F.sum("tp").alias("_p"), F.sum(F.col("n") - F.col("tp")).alias("_n"))
    return ranked.join(totals, keys).select(
        *by,
        F.col(cols.get("score", "score")).alias("threshold"),
        F.try_divide((F.col("cn") - F.col("ctp")).cast("double"), F.col("_n")).alias("fpr"),
        F.try_divide(F.col("ctp").cast("double"), F.col("_p")).alias("tpr"),
    )


def classification(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score",
    threshold: float = CLASS_THRESHOLD,
) -> DataFrame:
    """Precision, recall and F1 at a strict threshold; 0 where undefined."""
    said, is_pos = F.col(score) > threshold, F.col(label).cast("int") == 1
    counts = df.groupBy(*by).agg(
        F.count_if(said & is_pos).alias("tp"), F.count_if(said & ~is_pos).alias("fp"),
        F.count_if(~said & is_pos).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *by, ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(tp * 2, tp * 2 + fp + fn).alias("f1"),
    )


def report(df: DataFrame, label: str = "label", score: str = "score", digits: int | None = None) -> DataFrame:
    """One rounded row: F1, Gini, precision, recall, average precision.

    A constant helper column groups each part, so two one-row tables join; the areas
    come from one ranking.
    """
    one = df.select(F.lit(1).alias("_all"), label, score)
    cols = {"label": label, "score": score}
    gain = F.sum(F.col("tp") * F.col("ctp") / F.col("cn"))
    ranked = ranking(one, ["_all"], digits=digits, **cols).groupBy("_all").agg(
        (2 * area(F.col("n") - F.col("tp")) - 1).alias("gini"), ratio(gain, F.sum("tp")).alias("ap"))
    joined = classification(one, ["_all"], label, score).join(ranked, "_all")
    return joined.select(
        F.bround("f1", 3).alias("f1"), F.bround("gini", 2).alias("gini"),
        F.bround("precision", 3).alias("precision"), F.bround("recall", 3).alias("recall"),
        F.bround("ap", 3).alias("average_precision"),
    )


def log_loss(label: Column, prob: Column) -> Column:
    """Cross-entropy of one row, logarithms floored."""
    def log(p: Column) -> Column:
        return F.when(p <= 0, F.lit(LOG_FLOOR)).otherwise(F.greatest(F.ln(p), F.lit(LOG_FLOOR)))

    y = label.cast("double")
    return -(y * log(prob) + (1 - y) * log(1 - prob))


def cross_entropy(df: DataFrame, targets: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Mean cross-entropy per target and their sum; ``targets`` maps label to score."""
    means = [F.avg(log_loss(F.col(y), F.col(p).cast("double"))).alias(f"loss_{y}") for y, p in targets.items()]
    out = df.groupBy(*by).agg(*means)
    return out.withColumn("loss", sum((F.col(f"loss_{y}") for y in targets), F.lit(0.0)))


def contrastive_loss(
    df: DataFrame, vectors: Sequence[str], label: str, margin: float = MARGIN, eps: float = DISTANCE_EPS
) -> DataFrame:
    """Contrastive loss over the summed pairwise distances of three vectors."""
    def distance(a: str, b: str) -> Column:
        squares = F.zip_with(F.col(a), F.col(b), lambda x, y: F.pow(x.cast("double") - y + F.lit(eps), F.lit(2.0)))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))

    a, b, c = vectors
    d = distance(a, b) + distance(a, c) + distance(b, c)
    y = F.col(label).cast("double")
    gap = F.greatest(F.lit(margin) - d, F.lit(0.0))
    return df.agg(F.avg((1 - y) * d * d + y * gap * gap).alias("loss"), F.avg(d).alias("mean_distance"))
