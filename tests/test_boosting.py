"""Boosting on histograms: against brute force, against replayed models, and on held-out rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievespark.operators import boosting, models
from sievespark.operators.boosting import Ensemble, Settings
from sievespark.operators.metrics import average_precision
from sievespark.sources.stage import new_path


def frame(spark, x, *labels):
    rows = [(i, [None if math.isnan(c) else float(c) for c in v], *[None if y[i] is None else int(y[i]) for y in labels]) for i, v in enumerate(x)]
    names = ", ".join(f"y{k} int" for k in range(len(labels)))
    return spark.createDataFrame(rows, f"id bigint, features array<double>, {names}").repartition(4)


def tree_by_brute_force(x, g, h, edges, s):
    """{row: leaf value} of one tree: each level's best splits while leaves are left."""
    out, leaves, level = {}, 1, [np.arange(len(x))]
    strength = lambda a, b: max(abs(a) - s.l1, 0.0) ** 2 / (b + s.l2)

    def value(rows):
        a, b = g[rows].sum(), h[rows].sum()
        return -math.copysign(max(abs(a) - s.l1, 0.0), a) / (b + s.l2) * s.rate

    for _ in range(s.depth):
        found = []
        for rows in level:
            best = (0.0, 0, 0, None, None)
            for f, cuts in enumerate(edges):
                for b, cut in enumerate(cuts):
                    left, right = rows[x[rows, f] <= cut], rows[~(x[rows, f] <= cut)]
                    if min(len(left), len(right)) < s.min_rows or min(h[left].sum(), h[right].sum()) < s.min_hessian:
                        continue
                    gain = round(strength(g[left].sum(), h[left].sum()) + strength(g[right].sum(), h[right].sum()) - strength(g[rows].sum(), h[rows].sum()), 9)
                    best = max(best, (gain, -f, -b, left, right), key=lambda z: z[:3]) if gain > 0 else best
            found.append((best, rows))
        level = []
        for best, rows in sorted(found, key=lambda z: -z[0][0]):
            if best[3] is not None and leaves < s.leaves:
                leaves += 1
                level += [best[3], best[4]]
            else:
                out |= dict.fromkeys(rows.tolist(), value(rows))
    for rows in level:
        out |= dict.fromkeys(rows.tolist(), value(rows))
    return out


@pytest.mark.parametrize("s", [
    Settings(rounds=1, depth=1, min_rows=1, rate=1.0), Settings(rounds=1, depth=3, min_rows=8, rate=0.5, l1=1.0, l2=2.0),
    Settings(rounds=1, depth=6, min_rows=3, leaves=5, balance=False)])
def test_leaf_values_equal_brute_force(spark, s):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (160, 4)).astype(float)
    x[::17, 1] = np.nan
    y = ((x[:, 0] > 4) ^ (x[:, 2] > 6) ^ (rng.random(160) < 0.1)).astype(int)
    model = boosting.fit(frame(spark, x, y), "features", {"a": "y0"}, s)
    w = np.where(y > 0, (160 - y.sum()) / y.sum(), 1.0) if s.balance else np.ones(160)
    p = 1 / (1 + np.exp(-model.base[0]))
    assert p == pytest.approx((w * y).sum() / w.sum())
    want = tree_by_brute_force(x, w * (p - y), w * p * (1 - p), model.edges, s)
    got = model.trees[0][0].margins(model.code(x))
    assert np.allclose(got, [want[i] for i in range(160)], atol=1e-9) and len(set(want.values())) > 1
    assert sum(f < 0 for f in model.trees[0][0].feature) <= s.leaves


def planted(seed=3, n=4000, blocks=60):
    """Rows of blocks whose features decide the label, with noise; a tenth of the blocks is held out."""
    rng = np.random.default_rng(seed)
    block = rng.standard_normal((blocks, 6))
    at = rng.integers(0, blocks, (n, 2))
    x = np.concatenate([block[at[:, 0]], block[at[:, 1]]], axis=1)
    z = 2.0 * x[:, 0] - 1.5 * x[:, 7] + x[:, 3] * x[:, 9] - 2.5
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * z))).astype(int)
    held = (at < 6).any(axis=1)
    return x, y, held


def test_held_out_blocks_are_ranked_no_worse_than_by_the_library_fit(spark):
    x, y, held = planted()
    other = [None if i % 5 == 0 else int(v[2] > 0.8) for i, v in enumerate(x)]
    df = frame(spark, x, y, other).withColumn("val", F.col("id").isin([int(i) for i in np.nonzero(held)[0]]))
    report = []
    s = Settings(min_rows=50, rounds=8, rate=0.3, depth=5, balance=False)
    model = boosting.fit(df, "features", {"A": "y0", "B": "y1"}, s, F.col("val"), report=report)
    scored = boosting.score(model, df.where("val"), "features", ["id", "y0"]).withColumnRenamed("score_a", "score")
    rate = y[held].mean()
    ap = average_precision(scored.selectExpr("y0 as label", "score", "1 as g"), ["g"]).head()["ap"]
    assert ap > 1.5 * rate
    theirs = models.score(models.fit_boosted(df, "features", "y0", F.col("val"), weigh=False, min_leaf=50, maxDepth=5, stepSize=0.3, maxIter=8), df.where("val"), "features")
    loss = lambda d: d.select(F.avg(-F.when(F.col("y0") == 1, F.log("score")).otherwise(F.log1p(-F.col("score"))))).head()[0]
    assert loss(scored) <= loss(theirs)
    assert report[-1][0] < report[0][0] < math.log(2) and report[-1][1] < 0.5


def test_fit_stops_where_held_out_rows_stop_improving(spark):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((600, 3)), rng.integers(0, 2, 600)
    df = frame(spark, x, y)
    model = boosting.fit(df, "features", {"a": "y0"}, Settings(min_rows=5, rate=0.5, patience=2, rounds=8, depth=3), F.col("id") % 3 == 0)
    assert len(model.trees[0]) < 6
    nothing = boosting.fit(df.withColumn("y0", F.lit(1)), "features", {"a": "y0"}, Settings(min_rows=5))
    assert nothing.trees == [[]]
    with pytest.raises(ValueError):
        boosting.fit(df.limit(0), "features", {"a": "y0"})


def test_continued_over_parts(spark):
    """The margins of the rows equal those of the saved model; a run that was cut fits no part twice."""
    x, y, _ = planted(n=1500)
    df = frame(spark, x, y)
    s = Settings(rounds=2, min_rows=20, rate=0.3, depth=2)
    part = lambda k: lambda: df.where(F.col("id") % 3 == k)
    path = new_path(spark, "ensemble")

    def broken():
        raise RuntimeError("cut")

    with pytest.raises(RuntimeError):
        boosting.fit_over_parts(spark, [part(0), part(1), broken], "features", {"a": "y0"}, path, s)
    two = Ensemble.load(spark, f"{path}/after-00001")
    assert len(two.trees[0]) == 4
    model = boosting.fit_over_parts(spark, [broken, broken, part(2)], "features", {"a": "y0"}, path, s)
    assert len(model.trees[0]) == 6 and model.trees[0][:4] == two.trees[0]
    saved = Ensemble.load(spark, f"{path}/after-00002")
    assert saved == model
    bins = model.code(x)
    step = two.margins(bins) + sum(t.margins(bins)[:, None] for t in model.trees[0][4:])
    assert np.allclose(saved.margins(bins), step, atol=1e-12)
    table = boosting.coded(df, "features", [F.col("y0")], saved, [1.0], None)
    assert np.allclose(sorted(r["margin"][0] for r in table.collect()), sorted(step[:, 0]))
    whole = boosting.fit_over_parts(spark, [part(0), part(1), part(2)], "features", {"a": "y0"}, new_path(spark, "ensemble"), s)
    assert np.allclose(whole.margins(bins), saved.margins(bins), atol=1e-9)
    scored = {r["id"]: r["score_a"] for r in boosting.score(model, df, "features", ["id"]).collect()}
    assert np.allclose([scored[i] for i in range(1500)], 1 / (1 + np.exp(-step[:, 0])))


def test_held_sent_and_summed_rows_grow_the_same_trees(spark, monkeypatch):
    """Few distinct rows are held by the driver, sums of few tasks are sent to it: no level is a job of its own, or has no shuffle."""
    x, y, held = planted(n=400)
    x = np.round(x)
    df = frame(spark, np.concatenate([x, x[:150]]), np.concatenate([y, y[:150]]), np.concatenate([[None], y[1:], 1 - y[:150]]))
    s, found = Settings(rounds=3, min_rows=12, rate=0.3, depth=4, leaves=7), []
    jobs = spark.sparkContext.statusTracker()
    for k, (rows, sums) in enumerate(((64 << 20, 64 << 20), (0, 64 << 20), (0, 0))):
        monkeypatch.setattr(boosting, "HELD_BYTES", rows)
        monkeypatch.setattr(boosting, "SENT_BYTES", sums)
        report = []
        spark.sparkContext.setJobGroup(f"way{k}", "")
        model = boosting.fit(df, "features", {"a": "y0", "b": "y1"}, s, F.col("id") % 4 == 0, report=report)
        found.append((model, report, len(jobs.getJobIdsForGroup(f"way{k}"))))
    spark.sparkContext._jsc.clearJobGroup()
    shape = lambda m: [[(t.feature, t.bin, t.left, t.right) for t in trees] for trees in m.trees]
    assert shape(found[0][0])[0] and all(shape(m) == shape(found[0][0]) for m, _, _ in found[1:])
    for m, report, _ in found[1:]:
        assert np.allclose(m.margins(m.code(x)), found[0][0].margins(m.code(x)), atol=1e-9)
        assert np.allclose(np.array(report, float), np.array(found[0][1], float), atol=1e-9)
    assert found[0][2] < found[1][2] - 10 < found[2][2]
