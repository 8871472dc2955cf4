"""Hand-sized tables for edge cases."""

import math

import pytest
from conftest import close, values
from pyspark.sql import functions as F

from sievespark.functions import columns as c
from sievespark.operators import checks, entities, joins, keys, metrics, reduce, sampling, scoring, textfeatures


def scored(spark, rows):
    return spark.createDataFrame(rows, "grp string, split_group int, label int, score double")


def test_tied_scores_are_one_step(spark):
    df = scored(spark, [("a", 0, y, 0.5) for y in (1, 0, 0, 1)])
    assert close(metrics.average_precision(df, ["grp"]).head()["ap"], 0.5)
    assert close(metrics.roc_auc(df, ["grp"]).head()["auc"], 0.5)
    assert values(metrics.roc_points(df, ["grp"])) == [("a", 0.5, 1.0, 1.0)]


def test_one_class_groups_and_absent_pairs(spark):
    df = scored(spark, [("none", 0, 0, 0.2), ("none", 0, 0, 0.9), ("all", 1, 1, 0.1), ("all", 1, 1, 0.3)])
    assert values(metrics.average_precision(df, ["grp", "split_group"])) == [("all", 1, 1.0), ("none", 0, 0.0)]
    assert close(metrics.mean_average_precision(df, ["grp", "split_group"]).head()[0], 0.5)
    assert {r["auc"] for r in metrics.roc_auc(df, ["grp"]).collect()} == {None}
    assert values(metrics.classification(df, ["grp"])) == [("all", 0.0, 0.0, 0.0), ("none", 0.0, 0.0, 0.0)]


def test_metrics_equal_brute_force(spark):
    rows = [("g", 0, (i * 7) % 3 == 0 and 1 or 0, ((i * 37) % 11) / 10.0) for i in range(60)]
    df = scored(spark, rows)
    pos, neg = [r[3] for r in rows if r[2]], [r[3] for r in rows if not r[2]]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for s in sorted({r[3] for r in rows}, reverse=True):
        at = [r for r in rows if r[3] >= s]
        tp = sum(r[2] for r in at)
        ap += (tp - seen) / len(pos) * tp / len(at)
        seen = tp
    for digits in (None, 3):
        assert close(metrics.roc_auc(df, ["grp"], digits).head()["auc"], auc)
        assert close(metrics.average_precision(df, ["grp"], digits).head()["ap"], ap)


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.5,), (0.500001,)], "s double")
    assert values(df.select(c.to_class("s"))) == [(0,), (1,)]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.0125, 2.5, -2.5)], "a double, b double, d double")
    assert values(df.select(c.round_score("a"), c.round_score("b", 0), c.round_score("d", 0))) == [(0.012, 2.0, -2.0)]


def test_zero_pad_and_tag(spark):
    df = spark.createDataFrame([(7,), (42,), (1234,)], "n int")
    assert [r[0] for r in df.select(c.zero_pad("n", 3)).collect()] == ["007", "042", "1234"]
    tag = df.limit(1).select(c.output_tag("run", F.lit("2024-03-05").cast("date"), F.lit(0.291))).head()[0]
    assert tag == "run-20240305-029"


def test_any_true_treats_missing_as_false(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, True), (3, False, False)], "id int, a boolean, b boolean")
    assert values(df.select("id", c.any_true(["a", "b"]))) == [(1, False), (2, True), (3, False)]


def test_score_quality(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, None, nan, inf, -inf, -0.1, 1.1)], "s double")
    row = checks.score_quality(df, "s").head().asDict()
    assert row == {"n_rows": 8, "missing": 1, "not_a_number": 1, "infinite": 2, "below_zero": 1, "above_one": 1, "bad_rows": 6}


def test_require(spark):
    report = checks.row_count(spark.range(3), 3)
    checks.require(report, n_rows=3, as_expected=True)
    with pytest.raises(checks.CheckFailed):
        checks.require(report, n_rows=4)


def test_large_ids_do_not_collide(spark):
    big = 1 << 24
    rows = spark.createDataFrame([(1, big, "A"), (2, big + 1, "A"), (3, big + 2, "N")], "id bigint, entity_id bigint, grp string")
    found = spark.createDataFrame([(big, 0.1, 0.5), (big + 1, 0.2, 0.5)], "entity_id bigint, sa double, sn double")
    out = scoring.scored_output(rows, found, {"A": "sa", "N": "sn"})
    assert sorted((r["id"], r["score"]) for r in out.collect() if r["score"] is not None) == [(1, 0.1), (2, 0.2)]
    assert checks.null_counts(out, "score").head()[0] == 1


def test_unknown_block_is_reported_and_dropped(spark):
    blocks = spark.createDataFrame([(0, "x"), (1, "y")], "idx bigint, value string")
    df = spark.createDataFrame([(1, "x"), (2, "z")], "id int, b string")
    assert values(keys.encode(df, blocks, {"b": "b_idx"})) == [(1, 0)]
    assert values(checks.unknown_values(df, "b", blocks)) == [("z", 1)]


def test_entity_absent_from_a_group(spark):
    df = spark.createDataFrame(
        [(1, "A", 1, 5), (1, "N", 0, 5), (2, "N", None, 6), (2, "R", 1, 6)], "e int, g string, y int, b int")
    wide = entities.consolidate(df, "e", "g", "y", ["A", "N", "R"], carry=["b"])
    assert values(wide) == [(1, 5, True, False, False), (2, 6, False, False, True)]
    long = entities.long_form(wide, ["e"], {"A": "label_a", "R": "label_r"}, "g", "y")
    assert values(long) == [(1, "A", True), (1, "R", False), (2, "A", False), (2, "R", True)]


def test_alignment(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert values(checks.alignment(a, b, ["k"])) == [(1, 2)]
    assert values(checks.lost_rows(a, b, "k")) == [(1, 1)]
    assert values(checks.differing_rows(
        a.withColumn("v", F.lit(None).cast("int")), a.withColumn("v", F.lit(None).cast("int")), "k", ["v"])) == []


def test_sampling_shortfalls(spark):
    few = spark.createDataFrame([(i, i < 4) for i in range(10)], "id bigint, pos boolean")
    assert sampling.undersample(few, F.col("pos"), "id", 9, 1).count() == 10
    none = few.withColumn("pos", F.lit(False))
    assert sampling.oversample(none, F.col("pos"), 0.5).count() == 10
    assert sampling.oversample_exact(none, F.col("pos"), "id", 0.5, 1).count() == 10
    assert sampling.sample_exact(few, 50, "id", 1).count() == 10
    assert sampling.sample_exact(few, 0, "id", 1).count() == 0


def test_int8_range(spark):
    df = spark.createDataFrame([([0.127, -0.127, 0.128, -0.128, 0.9, -0.9, 0.0129],)], "v array<double>")
    kept, wrapped = df.select(reduce.quantise("v", 1000.0), reduce.quantise("v", 1000.0, "wrap")).head()
    assert kept == [127, -127, 127, -128, 127, -128, 12]
    assert wrapped == [127, -127, -128, -128, -124, 124, 12]


def test_quota_of_nothing_and_rows_without_a_group(spark):
    df = spark.createDataFrame([(i, f"g{i % 20}") for i in range(100)] + [(100 + i, None) for i in range(50)], "id int, g string")
    assert sampling.quota_sample(df, "g", "id", 10, 1).count() == 0
    assert sampling.sample_per_group(df, "g", "id", 0, 1).count() == 0
    kept = sampling.sample_per_group(df, "g", "id", 4, 1).groupBy("g").count().collect()
    assert len(kept) == 21 and all(r["count"] == 4 for r in kept)
    few = sampling.sample_per_group(df, "g", "id", 20, 1).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in few} == {**{f"g{i}": 5 for i in range(20)}, None: 20}


def test_class_ratio_divides_whole_numbers(spark):
    df = spark.createDataFrame([(i, int(i < 49)) for i in range(200)], "id int, y int")
    assert sampling.class_ratio(df, "y", "id", 49, 1).count() == 50


def test_missing_keys_hash_by_their_place(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), (None, None)], "x string, y string")
    assert df.select(c.key_hash("x", "y")).distinct().count() == 3


def test_text_edges(spark):
    df = spark.createDataFrame([(1, ""), (2, "one"), (3, "go go go"), (4, None), (5, " \n ")], "id int, text string")
    prints = {r["id"]: r["fingerprint"] for r in textfeatures.fingerprint_dense(df, "id", "text", bits=16).collect()}
    assert prints[1] == prints[4] == prints[5] == [-1] * 32
    assert sum(prints[2][16:]) == 1 and sum(prints[3][16:]) == 6
    assert textfeatures.fingerprint(df, "id", "text").groupBy("id").agg(F.sum("n")).count() == 2
    found = {r["id"]: r.asDict() for r in textfeatures.descriptors(df, "id", "text").collect()}
    assert found[4]["n_chars"] == -1 and found[5]["n_words"] == -1
    assert found[3]["n_words"] == 3 and found[3]["n_distinct_words"] == 1
    vocab = textfeatures.vocabulary(df, "text")
    assert values(vocab) == [(0, "go"), (1, "one")]
    assert values(textfeatures.token_pools(df, "id", "text", vocab)) == [(2, 1, 1.0, 1, 1), (3, 0, 1.0, 1, 3)]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>")
    assert values(reduce.standardise(df, "v")) == [([-1.0, 0.0],), ([1.0, 0.0],)]
    assert df.limit(1).select(reduce.normalise(F.array(F.lit(0.0), F.lit(0.0)))).head()[0] == [0.0, 0.0]


def test_probability_tolerance(spark):
    df = spark.createDataFrame([(0.5, 0.5 + 1e-9), (0.5, 0.51), (1.2, -0.2)], "a double, b double")
    assert values(checks.probabilities_sum_to_one(df, ["a", "b"])) == [(3, 1, 1)]


def test_cross_entropy_floor_and_contrastive_loss(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.0), (1, 1.0)], "y int, p double")
    assert close(metrics.cross_entropy(df, {"y": "p"}).head()["loss"], 100 / 3)
    v = spark.createDataFrame([([0.0], [3.0], [4.0], 0), ([0.0], [0.5], [0.5], 1)], "a array<double>, b array<double>, c array<double>, y int")
    found = metrics.contrastive_loss(v, ["a", "b", "c"], "y", eps=0.0).head()
    assert close(found["loss"], (64 + 1) / 2) and close(found["mean_distance"], 4.5)


def test_semi_anti_and_melt(spark):
    df = spark.createDataFrame([(1, 0, 1), (2, 2, 2), (3, 0, 2)], "id int, x int, y int")
    held = spark.createDataFrame([(0,)], "idx int")
    assert values(joins.semi_any(df, held, ["x", "y"], "idx"), "id") == [(1,), (3,)]
    assert values(joins.anti_each(df, held, ["x", "y"], "idx"), "id") == [(2,)]
    feats = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (2, [5, 6])], "idx int, features array<int>")
    star = values(joins.star_features(df, feats, ["x", "y"], ["id"]))
    assert star == [(1, [1, 2, 3, 4]), (2, [5, 6, 5, 6]), (3, [1, 2, 5, 6])]
    assert values(joins.melt_features(df, feats, "id", ["x", "y"])) == star


def test_feature_width_check(spark):
    df = spark.createDataFrame([([1, 2], [3])], "a array<int>, b array<int>")
    assert reduce.combine_features(df, ["a", "b"], 3).head()["features"] == [1, 2, 3]
    with pytest.raises(Exception, match="expected 4 features"):
        reduce.combine_features(df, ["a", "b"], 4).collect()


def test_component_search():
    cumulative = [0.5, 0.7, 0.85, 0.92, 0.96, 0.98, 0.99, 1.0]
    assert reduce.choose_components(cumulative, 100, 0.9) == 4  # starts above the cutoff and stays
    assert reduce.choose_components(cumulative, 100, 0.6) == 2  # walks down
    assert reduce.choose_components(cumulative, 100, 0.95) == 5  # walks up
    assert reduce.choose_components(cumulative, 100, 1.0) == 8
    wide = [(i + 1) / 200 for i in range(200)]
    assert reduce.choose_components(wide, 1000, 0.755) == 152  # steps of two from 100
    assert math.isclose(wide[151], 0.76)
