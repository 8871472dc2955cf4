"""Properties that must hold whatever the data, and agreement of alternative paths."""

import numpy as np
import pytest
from conftest import values
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievespark.functions.columns import any_true, key_hash
from sievespark.operators import graphs, keys, neighbours, reduce, sampling, similarity, splits, textfeatures, windows
from sievespark.operators.entities import dictionary, entities
from sievespark.plans.balance import held_split
from sievespark.sources import tables as t


@pytest.fixture(scope="module")
def ent(spark, sf_dir):
    return entities(spark, sf_dir).cache()


def skewed(spark, n=3000):
    """A third of the rows in one group, the rest over fifty."""
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).cast("int").alias("g"))


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("k"))
    rows = windows.dense_index(df, ["k"]).collect()
    assert [r["k"] for r in sorted(rows, key=lambda r: r["idx"])] == sorted(r["k"] for r in rows)
    assert sorted(r["idx"] for r in rows) == list(range(5000))


def test_running_totals_over_many_tasks(spark):
    df = skewed(spark).withColumn("v", F.col("id") % 5)
    order = [F.col("id").desc()]
    wide = windows.running_totals(df, ["g"], order, {"v": "s"})
    plain = windows.running_totals(df, ["g"], order, {"v": "s"}, bounded=True)
    assert values(wide, "id", "s") == values(plain, "id", "s")
    whole = windows.running_totals(df, [], [F.col("id")], {"v": "s"})
    assert whole.agg(F.max("s")).head()[0] == df.agg(F.sum("v")).head()[0]


def test_encode_decode_identity(spark, sf_dir):
    rows = t.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    blocks = keys.build_dictionary(keys.distinct_values(rows, ["p_name", "p_brand"]))
    coded = keys.encode(rows, blocks, {"p_name": "n", "p_brand": "b"})
    assert values(keys.decode(coded, blocks, {"n": "p_name", "b": "p_brand"})) == values(rows)


def test_split_partitions_entities_and_shares_no_held_block(spark, sf_dir):
    rows, marked = held_split(spark, sf_dir)
    held = {r["idx"] for r in marked.where("held").collect()}
    assert len(held) == -(-marked.count() // 10)
    for r in rows.collect():
        assert (r["split"] == "val") == any(r[c] in held for c in t.BLOCK_IDS)
    strict, marked = held_split(spark, sf_dir, splits.split_strict, 0.35)
    held = {r["idx"] for r in marked.where("held").collect()}
    for r in strict.collect():
        assert {r[c] in held for c in t.BLOCK_IDS} == {r["split"] == "val"}


def test_undersample_ratio(ent):
    kept = sampling.undersample(ent, any_true(t.LABELS), "entity_id", 2, 7)
    n_pos = ent.where(any_true(t.LABELS)).count()
    assert kept.where(any_true(t.LABELS)).count() == n_pos and kept.count() == min(3 * n_pos, ent.count())


def test_oversample_counts(ent):
    n, n_pos = ent.count(), ent.where(any_true(t.LABELS)).count()
    extra = -(-0.5 // (n_pos / n))
    assert sampling.oversample(ent, any_true(t.LABELS), 0.5).count() == n + n_pos * extra
    exact = sampling.oversample_exact(ent, any_true(t.LABELS), "entity_id", 0.5, 3)
    assert abs(exact.where(any_true(t.LABELS)).count() / exact.count() - 0.5) < 1 / exact.count() + 1e-9
    base = exact.groupBy("entity_id").count().join(ent, "entity_id").where(any_true(t.LABELS))
    spread = base.agg(F.max("count") - F.min("count")).head()[0]
    assert spread <= 1


@pytest.mark.parametrize("n", [1, 10, 999, 1700])
def test_cut_by_histogram_equals_sort(spark, monkeypatch, n):
    monkeypatch.setattr(sampling, "_TOP_N_ROWS", 5)
    monkeypatch.setattr(sampling, "_PREFIX_DIGITS", 1)
    df = spark.range(2000)
    got = {r[0] for r in sampling.sample_exact(df, n, "id", 3).collect()}
    want = {r[0] for r in df.orderBy(key_hash("id", seed=3)).limit(n).collect()}
    assert got == want


@pytest.mark.parametrize("quota", [1, 7, 30, 500, 5000])
def test_group_sample_equals_ranking(spark, quota):
    df = skewed(spark)
    w = W.partitionBy("g").orderBy(key_hash("id", seed=1))
    want = df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= quota)
    assert values(sampling.sample_per_group(df, "g", "id", quota, 1), "id") == values(want, "id")


def vectors(spark, n=400, dim=8, hot=True):
    """Vectors of which a third are copies of one."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(dim) if i % 3 or not hot else np.ones(dim)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, v array<double>"), {i: np.array(v) for i, v in rows}


@pytest.mark.parametrize("path", [{}, {"broadcast_rows": 0, "pivots": 5, "block_rows": 40, "slice_rows": 30}])
def test_nearest_equals_brute_force_with_copies(spark, path):
    df, found = vectors(spark)
    context, queries = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    got = {}
    for r in neighbours.nearest(queries, context, "id", "v", 3, **path).collect():
        got.setdefault(r["query_id"], []).append((r["dist"], r["context_id"]))
    for q in (i for i in found if i % 2):
        want = sorted((float(np.sqrt(((found[q] - found[c]) ** 2).sum())), c) for c in found if c % 2 == 0)[:3]
        assert [c for _, c in sorted(got[q])] == [c for _, c in want]
        assert np.allclose([d for d, _ in sorted(got[q])], [d for d, _ in want], atol=1e-9)


@pytest.mark.parametrize("path", [{}, {"block_rows": 3, "slice_rows": 4}])
def test_similarities_equal_brute_force(spark, path):
    rng = np.random.default_rng(1)
    sets = {i: set(map(int, rng.choice(32, rng.integers(0, 12), replace=False))) for i in range(20)}
    sets[0], sets[1] = set(), set(sets[2])
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id bigint, bits array<int>")
    context = rows.where("id < 8")
    got = {r["id"]: r.asDict() for r in similarity.mean_similarities(rows, context, "id", "id", n_bits=32, **path).collect()}
    for q, s in sets.items():
        want = dict.fromkeys(similarity.COEFFICIENTS, 0.0)
        for k in range(8):
            a, b, c = len(s), len(sets[k]), len(s & sets[k])
            if not a or not b:
                continue
            one = {
                "dice": 2 * c / (a + b), "tanimoto": c / (a + b - c), "cosine": c / (a * b) ** 0.5,
                "sokal": c / (2 * a + 2 * b - 3 * c), "russel": c / 32, "kulczynski": c * (a + b) / (2 * a * b),
                "mcconnaughey": (c * (a + b) - a * b) / (a * b), "tversky": 2 * c / (a + b)}
            for n in want:
                want[n] += one[n] / 8
        assert all(abs(got[q][n] - want[n]) < 1e-9 for n in want), q
        assert abs(got[q]["dice"] - got[q]["tversky"]) < 1e-12


def test_best_matches_recall(spark):
    rng = np.random.default_rng(2)
    base = {i: set(map(int, rng.choice(5000, 60, replace=False))) for i in range(60)}
    near = {i: set(list(s)[:50]) | {9000 + i * 3, 9001 + i * 3} for i, s in base.items()}
    near[99] = set()
    flat = lambda d: spark.createDataFrame([(i, sorted(s)) for i, s in d.items()], "id bigint, bits array<int>")
    got = {r["query_id"]: r for r in similarity.best_matches(flat(near), flat(base)).collect()}
    assert set(got) == set(near) and got[99]["context_id"] is None and got[99]["jaccard"] == 0
    right = [i for i in near if got[i]["context_id"] == i]
    assert len(right) / len(near) > 0.9
    assert abs(got[right[0]]["jaccard"] - 50 / 62) < 1e-9


def test_every_document_is_matched_and_recall_holds(spark):
    from sievespark.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.01"
    runs = {}
    for table, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        for r in textfeatures.run_sets(t.table(spark, sf, table), key, "text").collect():
            runs[table, r[key]] = set(r["bits"])
    docs, items = ({k: s for (n, k), s in runs.items() if n == table} for table in ("documents", "benchmark"))
    got = {r["query_id"]: r for r in QUERIES["y10_best_match"](spark, sf).collect()}
    assert set(got) == set(docs)
    hits = near = 0
    for d, s in docs.items():
        all_of = {i: len(s & b) / len(s | b) for i, b in items.items()}
        best = max(all_of.values())
        if got[d]["context_id"] is not None:
            assert abs(all_of[got[d]["context_id"]] - got[d]["jaccard"]) < 1e-12
        near += best >= 0.1
        hits += best >= 0.1 and got[d]["jaccard"] >= best - 1e-12
    assert near and hits >= 0.9 * near


def test_reduction_agrees_with_linear_algebra(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 6)) @ rng.standard_normal((6, 6)) + 3
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>")
    fitted = reduce.fit_reduction(df, "v", 0.8)
    z = (x - x.mean(0)) / x.std(0)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    z -= z.mean(0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    share = np.cumsum(s**2 / (s**2).sum())
    assert np.allclose(fitted.cumulative, share, atol=1e-9)
    assert fitted.components == reduce.choose_components(list(share), 200, 0.8)
    got = np.array([r["reduced"] for r in fitted.transform(df, "v").orderBy("id").collect()])
    want = (u * s)[:, : fitted.components]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_refinement_tells_graphs_apart(spark):
    path = [(1, "a", "b"), (1, "b", "c"), (1, "c", "d")]
    star = [(2, "a", "b"), (2, "a", "c"), (2, "a", "d")]
    again = [(3, "x", "y"), (3, "y", "z"), (3, "z", "w")]
    edges = spark.createDataFrame(path + star + again, "graph int, src string, dst string")
    found = {}
    for r in graphs.wl_labels(edges, rounds=2).collect():
        found.setdefault(r["graph"], set()).add((r["round"], r["label"], r["n"]))
    assert found[1] == found[3] and found[1] != found[2]
    assert sum(n for _, _, n in found[1]) == 12


def test_word_graphs_within_the_row_equal_the_joined_ones(spark, sf_dir):
    docs = t.texts(spark, sf_dir).where("doc_id < 40").unionByName(
        spark.createDataFrame([(900, "alone"), (901, "same same same"), (902, ""), (903, None)], "doc_id bigint, text string"))
    joined = graphs.wl_labels(graphs.token_edges(docs, "doc_id", "text"), graphs.token_nodes(docs, "doc_id", "text"))
    assert values(graphs.text_wl_labels(docs, "doc_id", "text"), "graph", "round", "label", "n") == values(
        joined, "graph", "round", "label", "n")
    every = graphs.graph_embeddings(graphs.text_wl_labels(docs, "doc_id", "text"), docs.selectExpr("doc_id as graph"))
    assert every.count() == docs.count()


def test_token_edges_by_hand(spark):
    df = spark.createDataFrame([(1, "b a b c c A"), (2, ""), (3, "x")], "id int, text string")
    assert values(graphs.token_edges(df, "id", "text")) == [
        (1, "A", "c", 1, "reverse"), (1, "a", "b", 2, "both"), (1, "b", "c", 1, "forward")]
    assert values(graphs.token_nodes(df, "id", "text"), "graph", "node", "occurrences") == [
        (1, "A", 1), (1, "a", 1), (1, "b", 2), (1, "c", 2), (3, "x", 1)]


def test_pools_equal_numpy(spark, sf_dir):
    from sievespark.operators.pooling import pool_vectors

    df = t.table(spark, sf_dir, "embeddings")
    rows = df.collect()
    for r in pool_vectors(df, ["label"], "embedding").collect():
        x = np.array([e["embedding"] for e in rows if e["label"] == r["label"]], dtype=float)
        assert np.allclose(r["pooled"], np.concatenate([x.mean(0), x.max(0), x.sum(0)]), atol=1e-9)


def test_sentence_vectors_skip_unknown_words(spark):
    df = spark.createDataFrame([(1, "a b " * 6), (2, "zzz")], "id int, text string")
    model = textfeatures.fit_word_vectors(df, "text", size=4, min_count=5, partitions=1)
    out = {r["id"]: r["features"] for r in textfeatures.sentence_vectors(df, "id", "text", model).collect()}
    assert len(out[1]) == 12 and set(out[1]) != {-1.0} and out[2] == [-1.0] * 12


def test_dictionary_is_sorted(spark, sf_dir):
    rows = dictionary(spark, sf_dir).orderBy("idx").collect()
    assert [r["value"] for r in rows] == sorted(r["value"] for r in rows)


@pytest.mark.parametrize("kind", ["bigint", "int"])
def test_best_matches_of_a_held_context_equal_joined_ones(spark, kind):
    """Also with repeated and null ids, empty, missing and gapped sets; a held context needs no join of sets."""
    rng = np.random.default_rng(8)
    one = lambda: sorted(map(int, rng.choice(np.arange(-40, 80), int(rng.integers(0, 30)), replace=False)))
    some = [(i % 70 if i % 9 else None, one()) for i in range(90)]
    queries = spark.createDataFrame([*some, (500, None), (501, [3, None, 7]), (502, [7000])], f"id bigint, bits array<{kind}>")
    context = spark.createDataFrame([*((i % 33 if i % 8 else None, one()) for i in range(40)), (99, [])], f"id bigint, bits array<{kind}>")
    rows = lambda df: sorted(map(str, df.collect()))
    for width, threshold in ((1, 0.0), (2, 0.2)):
        held, joined = (rows(similarity.best_matches(queries, context, 3, 2, width, threshold, held_bytes=n)) for n in (1 << 20, 0))
        assert held == joined and len(held) == 93 and sum("context_id=None" not in r for r in held) > 20
    alone = queries.where("id between 500 and 502").where("not exists(bits, b -> b is null)")
    plan = similarity.best_matches(alone, context, 3)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "array_intersect" not in plan


def test_hashes_equal_sparks(spark):
    x = np.array([0, 1, -1, 2**40 + 7, -(2**63), 2**63 - 1])
    got = spark.createDataFrame([(int(v),) for v in x], "x bigint").selectExpr("xxhash64(x) a", "xxhash64(x, 9) b", "xxhash64(cast(x % 100003 as int)) c").collect()
    low = np.fmod(x, 100003).astype(np.int32)
    once = similarity.xxhash64(x)
    assert [tuple(r) for r in got] == list(zip(once.tolist(), similarity.xxhash64(np.array([9], np.int32), once).tolist(), similarity.xxhash64(low).tolist()))


def test_rounds_of_relation_labels_leave_only_counts(spark):
    """Also with null ends and nodes without edges, as the joins of all rounds had them."""
    from sievespark.sources import stage

    edges = spark.createDataFrame([(1, "a", "b"), (1, "a", None), (2, "x", "x"), (None, "a", "b")], "graph int, src string, dst string")
    nodes = spark.createDataFrame([(1, "a"), (1, "lonely"), (3, "z")], "graph int, node string")
    before = set(stage._WRITTEN)
    got = graphs.wl_labels(edges, nodes, rounds=2)
    assert {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(stage._WRITTEN) - before} == {"wl-counts"}
    n = {}
    for r in got.collect():
        n[r["graph"], r["round"]] = n.get((r["graph"], r["round"]), 0) + r["n"]
    assert n == {(1, 0): 4, (1, 1): 4, (1, 2): 4, (2, 0): 1, (2, 1): 1, (2, 2): 1, (3, 0): 1, (3, 1): 1, (3, 2): 1, (None, 0): 2}
