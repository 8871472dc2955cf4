"""Plan shapes: pushdown, pruning, and the absence of what does not scale."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from sievespark.operators import graphs, sampling, splits, textfeatures
from sievespark.plans.catalog import QUERIES
from sievespark.sources import tables as t


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["s3_filtered_scan"](spark, sf_dir))
    assert "EqualTo(l_returnflag,R)" in text
    assert "l_extendedprice" not in text and "l_shipdate" not in text


def test_group_folder_is_pruned(spark, sf_dir):
    text = plan(QUERIES["s9_group_sink"](spark, sf_dir))
    assert "PartitionFilters: [isnotnull(grp" in text


def test_counting_within_texts_does_not_shuffle(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    text = plan(textfeatures.fingerprint(docs, "doc_id", "text"))
    assert "Exchange" not in text
    assert text.count("split(") == 1  # no inferred filter splits the text again


def test_split_and_sample_are_filters(spark, sf_dir):
    rows = t.table(spark, sf_dir, "orders").select("o_orderkey")
    assert "Exchange" not in plan(sampling.sample_exact(rows, 100, "o_orderkey", 1))
    assert "Exchange" not in plan(splits.split_any(rows, ["o_orderkey"], "8"))
    positive = F.col("o_orderkey") % 50 == 0
    assert "Exchange" not in plan(sampling.undersample(rows, positive, "o_orderkey", 2, 1))


def test_linear_means_need_no_pairs_and_word_graphs_no_shuffle(spark, sf_dir):
    for name in ("y1_dice", "y3_tversky", "y4_cosine", "y6_russel", "y7_kulczynski", "y8_mcconnaughey"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "CoGroup" not in text and "Join" not in text
    assert "Exchange" not in plan(graphs.text_wl_labels(t.table(spark, sf_dir, "documents"), "doc_id", "text"))


def test_stages_are_not_rebuilt(spark, sf_dir):
    for name, most in (("p5_any_label", 8), ("m6_ensemble", 8), ("b5_quota_sample", 2)):
        assert plan(QUERIES[name](spark, sf_dir)).count("\nLocation:") <= most


@pytest.mark.parametrize("name", [
    "j2_star_features", "j5_semi_any", "v4_split_report", "y9_mean_similarities", "y10_best_match", "j8_nearest_approx",
    "j9_nearest_cells", "x1_average_precision", "m9_scored_output", "f3_token_pools",
])
def test_no_cross_join(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
