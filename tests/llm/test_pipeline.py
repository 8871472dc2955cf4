"""Every stage of the corpus pipeline against brute force, each on what its predecessor kept."""

import collections
import re

from test_llm import check_packing, fingerprint, lines_by_brute_force, linked, normal

import corpus_pipeline
from sievespark.llm import language
from sievespark.sources.stage import materialize


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame(
        [(10_000, None, "en", "s", 0), (10_001, "12 34 !!", "en", "s", 8), (10_002, "12 34 !!", None, None, None)], docs.schema)
    at = docs.unionByName(extra)
    kept = {}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, materialize(stage(spark, at, sf_dir), "stage")
        if name != "packing":
            assert at.columns == docs.columns
            kept[name] = (before.collect(), at.collect())
        else:
            assert check_packing(at.collect(), before) < 0.05

    before, after = kept["language"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if language.has_letter(r.text)}

    before, after = kept["lines"]
    want, _ = lines_by_brute_force([(r.doc_id, r.text) for r in before])
    left = {r.doc_id: r.text for r in after}
    removed = true = 0
    for r in before:
        lines, gone = r.text.split("\n"), want.get((r.doc_id, r.text), set())
        new = left.get(r.doc_id, "").split("\n")
        n = len(lines) - (len(new) if r.doc_id in left else 0)
        removed, true = removed + n, true + len(gone)
        own = collections.Counter(new)
        assert all(own[x] or k in gone or not normal(x) for k, x in enumerate(lines))
        assert r.doc_id in left or gone >= {k for k, x in enumerate(lines) if normal(x)}
    assert removed >= 0.9 * true

    before, after = kept["near duplicates"]
    root = linked([fingerprint(r.text) for r in before], lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for r, c in zip(before, root):
        first[c] = min(first.get(c, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(first.values())

    before, after = kept["decontamination"]
    tok = lambda t: re.findall(r"\w+", t.lower())
    grams = collections.defaultdict(set)
    for i in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = tok(i.text)
        n = min(13, -(-len(w) * 4 // 5))
        grams[n] |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    dirty = {r.doc_id for r in before for w in [tok(r.text)] for n, g in grams.items() if any(tuple(w[k : k + n]) in g for k in range(len(w) - n + 1))}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - dirty


def test_registered(spark, sf_dir):
    import __spark_entry__ as registered

    assert registered.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
