"""The exact join by pivots and the saved index, against brute force."""

import numpy as np
import pytest
from conftest import values
from pyspark.sql import functions as F

from sievespark.operators import neighbours, pivot_join, vector_index
from sievespark.sources import tables as t
from sievespark.sources.stage import new_path


def frame(spark, rows):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id bigint, vec array<double>")


def clustered(n=1200, dim=8, seed=4):
    """Tight clusters, one of which holds a third of the rows; a tenth are copies of one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, dim)) * 10
    at = np.where(rng.random(n) < 0.33, 0, rng.integers(0, 40, n))
    rows = centres[at] + 0.05 * rng.standard_normal((n, dim))
    rows[::10] = rows[0]
    return rows


def brute(rows, queries, context, k):
    out = {}
    for q in queries:
        d = np.sqrt(((rows[context] - rows[q]) ** 2).sum(axis=1))
        order = np.lexsort((context, d))[:k]
        out[q] = [(int(context[i]), round(float(d[i]), 9)) for i in order]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["dist"], r["context_id"]))
    return {q: [(c, round(d, 9)) for d, c in sorted(x)] for q, x in out.items()}


@pytest.mark.parametrize("sizes", [{"block_rows": 20, "slice_rows": 15}, {"pivots": 1, "block_rows": 50}, {"pivots": 600, "block_rows": 4}])
def test_pivot_join_equals_brute_force(spark, sizes, k=6):
    rows = clustered(700)
    df = frame(spark, rows)
    ids = np.arange(len(rows))
    got = neighbours.nearest(df.where("id % 2 = 1"), df.where("id % 2 = 0"), "id", "vec", k, broadcast_rows=0, **sizes)
    assert found(got) == brute(rows, ids[1::2], ids[::2], k)


def test_pivot_join_of_few_rows(spark):
    rows = np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 0.0], [5.0, 5.0]])
    df = frame(spark, rows)
    got = neighbours.nearest(df, df.where("id < 3"), "id", "vec", 5, broadcast_rows=0)
    assert found(got) == brute(rows, np.arange(4), np.arange(3), 5)


def test_queries_visit_few_rings_and_rings_are_copied_for_their_own_visits_only(spark):
    rows = clustered(3000)
    df = frame(spark, rows)
    sides = neighbours.materialize(df.where("id % 2 = 1")), neighbours.materialize(df.where("id % 2 = 0"))
    join = pivot_join.PivotJoin(*sides, 5, neighbours.top_k, block_rows=25, slice_rows=100)
    assert join.total_rings > 60
    first = join.first.groupBy("id").count()
    assert first.count() == 1500 and first.agg(F.max("count")).head()[0] == 1
    onward = join.second.count() / 1500
    assert onward < 0.25 * join.total_rings
    # A ring's copies are the slices of its own visits; most rings have one.
    visits = [r["count"] for r in join.second.groupBy("cell", "ring").count().collect()]
    copies = [-(-v // 100) for v in visits]
    assert sum(copies) < 0.5 * join.total_rings * max(copies)
    assert pivot_join.pivots_for(10**6, 64) == 1000 and pivot_join.pivots_for(10**12, 64) == pivot_join.MAX_PIVOTS


def recall(approx, exact):
    a, e = set(values(approx, "query_id", "context_id")), set(values(exact, "query_id", "context_id"))
    return len(a & e) / len(e)


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_index_recall(spark, sf):
    """Recall at 5 of at least 0.9 over all embeddings, with few vectors compared exactly."""
    df = t.table(spark, f"/root/testdata/sf{sf}", "embeddings")
    context, queries = neighbours.split_half(df, "vec_id", 21)
    exact = neighbours.nearest(queries, context, "vec_id", "embedding", 5)
    index = vector_index.VectorIndex.build(context, "vec_id", "embedding", new_path(spark, "index"))
    assert index.lists.count() == context.count()
    got = index.search(queries, "vec_id", "embedding", 5)
    per_query = got.groupBy("query_id").count()
    assert per_query.count() == queries.count() and per_query.agg(F.max("count")).head()[0] == 5
    assert recall(got, exact) >= 0.9
    true = {r[:2]: r[2] for r in values(exact, "query_id", "context_id", "dist")}
    assert all(abs(true.get((q, c), d) - d) < 1e-9 for q, c, d in values(got, "query_id", "context_id", "dist"))
    assert vector_index.RERANK * 5 <= 20


def test_index_of_clusters_visits_few_cells(spark, monkeypatch):
    """Also when cells are cut into blocks and slices."""
    rows = clustered(2000)
    rows = rows + 0.01 * np.random.default_rng(1).standard_normal(rows.shape)
    df = frame(spark, rows)
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 60)
    monkeypatch.setattr(vector_index, "SLICE_ROWS", 50)
    monkeypatch.setattr(vector_index, "LIST_ROWS", 100)
    index = vector_index.VectorIndex.build(df, "id", "vec", new_path(spark, "index"))
    assert index.quantiser.probes < len(index.quantiser.cells) / 4
    exact = neighbours.nearest(df, df, "id", "vec", 5)
    assert recall(index.search(df, "id", "vec", 5), exact) >= 0.9


def test_index_is_saved_reused_and_extended(spark):
    rows = clustered(300)
    df = frame(spark, rows).unionByName(spark.createDataFrame([(1000, None), (None, [0.0] * 8)], "id bigint, vec array<double>"))
    path = new_path(spark, "index")
    built = []

    def build():
        built.append(1)
        return vector_index.VectorIndex.build(df.where("id < 200 or id >= 1000 or id is null"), "id", "vec", path)

    first = vector_index.VectorIndex.load_or_build(spark, path, build)
    again = vector_index.VectorIndex.load_or_build(spark, path, build)
    assert len(built) == 1 and again.lists.count() == 200
    some = df.where("id < 50")
    assert values(first.search(some, "id", "vec")) == values(again.search(some, "id", "vec"))
    again.add(df.where("id >= 200"), "id", "vec")
    assert again.lists.count() == 300
    got = again.search(df.where("id = 250"), "id", "vec", 3).orderBy("dist", "context_id").head()
    assert got["dist"] == 0.0
    with pytest.raises(ValueError):
        vector_index.VectorIndex.build(df.limit(0), "id", "vec", path)
