"""Reduction without a covariance matrix, against the fitted chain and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievespark.operators import reduce, wide_reduction
from sievespark.sources import tables as t


def test_equals_the_covariance_fit(spark, sf_dir):
    """Same component count, and the same numbers up to their sign."""
    df = t.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ours, theirs = wide_reduction.fit_wide_reduction(df, "embedding", 0.9), reduce.fit_reduction(df, "embedding", 0.9)
    assert ours.components == theirs.components and ours.explained == pytest.approx(theirs.explained, abs=1e-9)
    a, b = (np.array([r["reduced"] for r in m.transform(df, "embedding").orderBy("vec_id").collect()]) for m in (ours, theirs))
    assert np.abs(np.abs(a) - np.abs(b)).max() < 1e-6


def test_wide_lists(spark):
    """20,000 columns of which a few directions matter; the block grows until it explains enough."""
    rng = np.random.default_rng(3)
    n, width = 160, 20_000
    x = (rng.standard_normal((n, 12)) * np.linspace(6, 2, 12)) @ rng.standard_normal((12, width)) + 0.05 * rng.standard_normal((n, width)) + 1
    x[:, 7] = 3.0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "id int, v array<float>").repartition(4)
    model = wide_reduction.fit_wide_reduction(df, "v", 0.95, start=4)
    x = x.astype(np.float32).astype(float)
    sd = x.std(0)
    z = np.where(sd > 1e-9, (x - x.mean(0)) / np.where(sd > 1e-9, sd, 1), 0)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    z -= z.mean(0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    share = np.cumsum(s**2) / (s**2).sum()
    k = reduce.choose_components([*share, *[1.0] * (width - n)], n, 0.95)
    assert model.components == min(k, len(model.cumulative)) and model.basis.shape[0] == width
    got = {r["id"]: r["reduced"] for r in model.transform(df, "v").collect()}
    assert got[999] is None
    a = np.array([got[i] for i in range(n)])
    top = 8
    assert np.allclose(model.cumulative[:top], share[:top], atol=1e-6)
    assert np.abs(np.abs(a[:, :top]) - np.abs((u * s)[:, :top])).max() < 1e-4


def test_no_rows_and_constant_rows(spark):
    with pytest.raises(ValueError):
        wide_reduction.fit_wide_reduction(spark.createDataFrame([], "v array<double>"), "v")
    df = spark.createDataFrame([([1.0, 2.0],)] * 3, "v array<double>")
    model = wide_reduction.fit_wide_reduction(df, "v")
    assert all(np.allclose(r["reduced"], 0) for r in model.transform(df, "v").select(F.col("reduced")).collect())
