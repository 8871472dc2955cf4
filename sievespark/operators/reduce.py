"""Scaling, PCA with an explained-variance cutoff, and int8 quantisation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, Normalizer, StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import INT8_MAX, INT8_MIN

# The search grid of the component count.
WIDE_COLUMNS = 100
WIDE_STEP_SHARE = 0.01
START_SHARE = 2


def as_vector(df: DataFrame, col: str, out: str = "_x") -> DataFrame:
    """Add a vector column for ML stages."""
    return df.withColumn(out, array_to_vector(F.col(col).cast("array<double>")))


def scaler(n_rows: int, width: int, source: str, target: str) -> list:
    """Standardise by the population deviation (Spark's scaler uses the sample one)."""
    factor = math.sqrt(n_rows / (n_rows - 1)) if n_rows > 1 else 1.0
    return [
        StandardScaler(inputCol=source, outputCol="_sample_scaled", withMean=True, withStd=True),
        ElementwiseProduct(scalingVec=Vectors.dense([factor] * width), inputCol="_sample_scaled", outputCol=target),
    ]


def standardise(df: DataFrame, col: str) -> DataFrame:
    """Zero mean and unit population variance per position; constant positions become 0."""
    rows = as_vector(df, col)
    n, width = rows.count(), len(df.select(col).head()[0])
    model = Pipeline(stages=scaler(n, width, "_x", "_scaled")).fit(rows)
    return model.transform(rows).withColumn(col, vector_to_array("_scaled")).select(*df.columns)


def normalise(col: str | Column) -> Column:
    """Scale a list to length one; a zero list stays zero."""
    c = F.col(col) if isinstance(col, str) else col
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(c, lambda x: x.cast("double") / norm)).otherwise(
        F.transform(c, lambda x: x.cast("double")))


def choose_components(cumulative: list[float], n_rows: int, cutoff: float, step: int | None = None) -> int:
    """Component count on the search grid.

    Starts at half of the smaller dimension. If that explains more than the
    cutoff, the smallest grid point below it that is still not under the cutoff;
    otherwise the first grid point above the cutoff, or all columns.
    """
    width = len(cumulative)
    if step is None:
        step = int(WIDE_STEP_SHARE * width) if width > WIDE_COLUMNS else 1
    k = max(int(min(n_rows, width) / START_SHARE), 1)

    def explained(i: int) -> float:
        return cumulative[min(i, width) - 1]

    if explained(k) > cutoff:
        while k - step >= 1 and explained(k - step) >= cutoff:
            k -= step
        return k
    while k < width and explained(k) <= cutoff:
        k = min(k + step, width)
    return k


@dataclass
class Reduction:
    """A fitted scale, normalise, PCA chain."""

    model: PipelineModel
    components: int
    explained: float
    cumulative: list[float]

    def transform(self, df: DataFrame, col: str, out: str = "reduced") -> DataFrame:
        """Add the reduced list; the key stays in the row."""
        reduced = self.model.transform(as_vector(df, col))
        return reduced.withColumn(out, vector_to_array("_pca")).select(*df.columns, out)


def fit_reduction(df: DataFrame, col: str, cutoff: float = 0.95, step: int | None = None) -> Reduction:
    """Fit the chain once with all components and keep the leading ones.

    Components are nested, so the search over their number needs no refits: the
    cumulative explained variance of one fit answers it, and a slicer keeps the
    chosen ones. The covariance (width x width) is all the driver sees.
    """
    rows = as_vector(df.select(col), col)
    n, width = rows.count(), len(df.select(col).head()[0])
    prepare = Pipeline(stages=[
        *scaler(n, width, "_x", "_scaled"),
        Normalizer(p=2.0, inputCol="_scaled", outputCol="_unit"),
    ]).fit(rows)
    unit = prepare.transform(rows).select("_unit")
    # The projection itself does not subtract the mean, so a stage does.
    project = Pipeline(stages=[
        StandardScaler(inputCol="_unit", outputCol="_centred", withMean=True, withStd=False),
        PCA(k=width, inputCol="_centred", outputCol="_full"),
    ]).fit(unit)
    cumulative, total = [], 0.0
    for share in project.stages[-1].explainedVariance.toArray():
        total += float(share)
        cumulative.append(total)
    k = choose_components(cumulative, n, cutoff, step)
    keep = VectorSlicer(inputCol="_full", outputCol="_pca", indices=list(range(k)))
    model = PipelineModel(stages=[*prepare.stages, *project.stages, keep])
    return Reduction(model, k, cumulative[k - 1], cumulative)


def quantise(col: str | Column, scale: float | Column, mode: str = "saturate") -> Column:
    """Multiply, drop the fraction, and store as int8.

    ``saturate`` keeps out-of-range values at the limits; ``wrap`` keeps the low byte.
    """
    def one(x: Column) -> Column:
        v = x.cast("double") * scale
        whole = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))
        if mode == "wrap":
            return (F.pmod(whole.cast("bigint") + 128, F.lit(256)) - 128).cast("tinyint")
        return F.least(F.greatest(whole, F.lit(INT8_MIN)), F.lit(INT8_MAX)).cast("tinyint")

    return F.transform(col, one)


def full_scale(df: DataFrame, col: str) -> float:
    """The scale that maps the largest absolute value of a column of lists to 127."""
    largest = F.array_max(F.transform(col, lambda x: F.abs(x.cast("double"))))
    top = df.agg(F.max(largest)).head()[0]
    return INT8_MAX / top if top else 1.0


def dequantise(col: str | Column, scale: float) -> Column:
    """Approximate original values."""
    return F.transform(col, lambda x: x.cast("double") / scale)


def quantisation_error(df: DataFrame, col: str, scale: float, mode: str = "saturate") -> DataFrame:
    """Largest and mean absolute error of storing a column of lists as int8."""
    back = dequantise(quantise(col, scale, mode), scale)
    errors = F.zip_with(F.col(col), back, lambda a, b: F.abs(a.cast("double") - b))
    per = df.select(
        F.array_max(errors).alias("_max"), F.aggregate(errors, F.lit(0.0), lambda s, e: s + e).alias("_sum"),
        F.size(col).alias("_n"))
    return per.agg(F.max("_max").alias("max_error"), (F.sum("_sum") / F.sum("_n")).alias("mean_error"))


def varying(df: DataFrame, col: str, out: str = "varying") -> DataFrame:
    """The positions of a list column that aren't the same in all rows.

    Constant positions become 0 when scaled, so a reduction is the same without
    them and far cheaper where few of many hashed positions are set.
    """
    spans = df.select(F.posexplode(col).alias("pos", "v")).groupBy("pos").agg(F.min("v").alias("low"), F.max("v").alias("top"))
    positions = [r["pos"] for r in spans.where("low <> top").orderBy("pos").collect()]  # at most the width
    return df.withColumn(out, F.transform(F.array(*[F.lit(p) for p in positions]), lambda p: F.get(col, p)))


def combine_features(df: DataFrame, cols: list[str], width: int, out: str = "features") -> DataFrame:
    """Several feature lists in one; fails on a row of another width."""
    joined = F.concat(*cols)
    checked = F.when(F.size(joined) == width, joined).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {width} features, found "), F.size(joined).cast("string"))))
    return df.withColumn(out, checked)
