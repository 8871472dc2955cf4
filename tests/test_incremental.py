"""Streaming over arriving files, and stages that are skipped when complete."""

import pytest
from conftest import values
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sievespark.operators import models
from sievespark.sources import stage, tables as t
from sievespark.streaming import incremental as inc


def test_files_that_arrive_later(spark, sf_dir):
    folder, out, state, counts, state2 = (stage.new_path(spark, n) for n in ("in", "out", "state", "counts", "state"))
    parts = t.table(spark, sf_dir, "part")
    for i, half in enumerate((parts.where("p_partkey < 90"), parts.where("p_partkey >= 90"))):
        half.coalesce(1).write.mode("append").parquet(folder)
        stream = inc.arriving(spark, folder, "part", "*.parquet", files_per_batch=1)
        inc.finish(inc.running_dictionary(stream, ["p_name", "p_brand"], out, state))
        inc.finish(inc.running_counts(stream, ["p_type"], counts, state2))
        seen = parts if i else half
        want = values(seen.select(F.explode(F.array("p_name", "p_brand")).alias("v")).distinct())
        assert values(spark.read.schema("value string").parquet(out)) == want
        assert values(inc.latest_counts(spark, counts), "p_type", "n") == values(seen.groupBy("p_type").count())


def test_ids_stay_over_batches_and_restarts(spark, sf_dir, monkeypatch):
    folder, out, state = (stage.new_path(spark, n) for n in ("in", "out", "state"))
    parts = t.table(spark, sf_dir, "part")
    cols = ["p_name", "p_brand"]
    halves = [parts.where("p_partkey < 60"), parts.where("p_partkey between 60 and 120"), parts.where("p_partkey > 120")]

    def run():
        inc.finish(inc.stable_ids(inc.arriving(spark, folder, "part", "*.parquet", files_per_batch=1), cols, out, state))
        return {r["value"]: r["id"] for r in inc.ids_of(spark, out).collect()}

    halves[0].coalesce(1).write.mode("append").parquet(folder)
    first = run()
    for half in halves[1:]:
        half.coalesce(1).write.mode("append").parquet(folder)
    # The run is cut after a batch's ids are written, before the batch is finished.
    real = inc.dense_index

    def cut(batch, *args):
        rows = real(batch, *args)
        rows.selectExpr("value", "id + 1000 as id").write.mode("overwrite").parquet(f"{out}/batch=1")
        raise RuntimeError("cut")

    monkeypatch.setattr(inc, "dense_index", cut)
    with pytest.raises(Exception, match="cut"):
        run()
    monkeypatch.setattr(inc, "dense_index", real)
    every = run()
    assert {v: every[v] for v in first} == first and sorted(every.values()) == list(range(len(every)))
    assert set(every) == {r[0] for r in parts.select(F.explode(F.array(*cols))).distinct().collect()}
    assert run() == every


def test_repeated_batch_overwrites_itself(spark, sf_dir):
    out = stage.new_path(spark, "sink")
    for _ in range(2):  # a new checkpoint makes the same batch number run again
        stream = inc.arriving(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("grp"))
        inc.finish(inc.per_group_sink(stream, lambda b: b, "grp", out, stage.new_path(spark, "state")))
    assert spark.read.parquet(out).count() == t.table(spark, sf_dir, "lineitem").count()


def test_complete_stage_is_skipped(spark):
    path, calls = stage.new_path(spark, "stage"), []

    def build(n):
        calls.append(n)
        return spark.range(n)

    assert stage.run_stage(spark, path, lambda: build(3)).count() == 3
    assert stage.run_stage(spark, path, lambda: build(5)).count() == 3
    assert stage.run_stage(spark, path, lambda: build(7), from_scratch=True).count() == 7
    assert calls == [3, 7]


def test_saved_model_is_reloaded(spark):
    rows = spark.createDataFrame([([float(i), 1.0], int(i > 10)) for i in range(20)], "f array<double>, y int")
    path, fits = stage.new_path(spark, "model"), []

    def fit():
        fits.append(1)
        return models.fit_boosted(rows, "f", "y", min_leaf=1, maxDepth=2, maxIter=3)

    first = stage.load_or_fit(spark, path, PipelineModel, fit)
    second = stage.load_or_fit(spark, path, PipelineModel, fit)
    assert len(fits) == 1
    assert values(models.score(first, rows, "f"), "f", "score") == values(models.score(second, rows, "f"), "f", "score")
    scored = {tuple(r["f"]): r["score"] for r in models.score(first, rows, "f").collect()}
    assert scored[(19.0, 1.0)] > 0.5 > scored[(0.0, 1.0)]
    # A save that broke off has no marker: the model is fitted again.
    half = stage.new_path(spark, "half")
    spark.range(1).write.parquet(half)
    stage.load_or_fit(spark, half, PipelineModel, fit)
    assert len(fits) == 2


def test_release_deletes_stage_tables(spark):
    df = stage.materialize(spark.range(3), "gone")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert stage.path_exists(spark, path)
    stage.release(spark)
    assert not stage.path_exists(spark, path)
