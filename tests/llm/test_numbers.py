"""Mixing, spelling variants and whitening against brute force."""

from __future__ import annotations

import collections
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sievespark.llm import mixing, spelling, whitening

from test_llm import WORD, awkward, docs, empty, table, words  # noqa: F401


# 11 ----------------------------------------------------------------------------------------


def targets_by_rounds(sizes, share=1.5):
    """{source: target}: the excess of sources at their limit is shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    limit = {s: 2 * n for s, n in sizes.items()}
    out, left, total = {}, set(order), share * sum(sizes.values())
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] >= limit[s]}
        out |= {s: limit[s] for s in over} or {s: level * weight[s] for s in left}
        left -= set(out)
    return out


@pytest.mark.parametrize("block, shard", [(512, 512), (7, 5)])
def test_mix_meets_its_targets(spark, table, docs, empty, block, shard):  # noqa: F811
    for df in (table, docs, empty) if block == 512 else (table,):
        rows = df.select("doc_id", "text", "source").collect()
        sizes = collections.Counter()
        for r in rows:
            sizes[r.source] += len(words(r.text))
        want = targets_by_rounds(sizes)
        mix = mixing.Mix(df, block, shard)
        got = mix.taken().collect()
        assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in got)
        by_text = collections.Counter((r.doc_id, len(words(r.text)), sizes[r.source], round(want[r.source], 4)) for r in rows)
        assert collections.Counter((r.doc_id, r["size"], r.source_size, round(r.target, 4)) for r in got) == by_text
        taken = collections.Counter()
        for r in got:
            taken[round(r.target, 4), r.source_size] += r.taken
        due = collections.Counter()
        for s, n in sizes.items():
            due[round(want[s], 4), n] += math.floor(want[s] + 0.5)
        assert all(taken[k] == v for k, v in due.items())
        if df is table and block == 7:
            again = mixing.Mix(df.repartition(5, "doc_id"), block, shard).taken()
            assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_mixed_blocks_are_words_of_their_source(spark, table):  # noqa: F811
    mix = mixing.Mix(table, 7, 5)
    stream = collections.defaultdict(list)
    place = {(r.doc_id, r.sum, r.offset): r.s for r in mix.documents.collect() if r["size"]}
    texts = {(r.doc_id, r.sum): words(r.text) for r in table.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as sum").collect()}
    for (d, h, at), s in sorted(place.items(), key=lambda x: x[0][2]):
        assert len(stream[s]) == at
        stream[s] += texts[d, h]
    names = {r.s: r.src for r in mix.sources.collect()}
    cut = {(r.shard, r.slot): (r.s, r.block, r.cut) for r in mix.slots.collect()}
    out = mix.blocks().collect()
    assert len(out) == len(cut) == len({(r.shard, r.slot) for r in out})
    for r in out:
        s, block, gone = cut[r.shard, r.slot]
        own = stream[s][7 * block : 7 * block + 7]
        assert r.text == " ".join(own[: len(own) - gone]) and r.source == names[s] and r.n_words == len(own) - gone
    uses = collections.Counter((s, b) for s, b, _ in cut.values())
    assert max(uses.values()) == 2


def test_draws_are_multinomial_and_use_every_index_once(spark):
    due = [5000, 1, 0, 900, 2500, 37]
    src = spark.createDataFrame([(i, n) for i, n in enumerate(due)], "s long, due long")
    rows = mixing.draw_slots(src, 64).collect()
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) == sum(due)
    assert {(r.s, r["index"]) for r in rows} == {(i, k) for i, n in enumerate(due) for k in range(n)}
    counts = collections.Counter((r.shard, r.s) for r in rows)
    shards = sum(due) // 64
    p = due[0] / sum(due)
    first = [counts[k, 0] for k in range(shards)]
    assert abs(np.mean(first) - 64 * p) < 1 and 0.6 < np.var(first) / (64 * p * (1 - p)) < 1.5


@pytest.mark.parametrize("size", [1, 2, 3, 64, 1000, 70_001])
def test_block_permutation(size):
    i = np.arange(size)
    p, q = (mixing.permuted(i, np.full(size, size), np.full(size, 3), np.full(size, t)) for t in (0, 1))
    assert sorted(p) == sorted(q) == i.tolist() and (size < 64 or (p != q).mean() > 0.9)
    assert (mixing.permuted(p, np.full(size, size), np.full(size, 3), np.zeros(size, int), back=True) == i).all()


# 12 ----------------------------------------------------------------------------------------


def variants_by_brute_force(rows):
    count = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= 6
    n = {w: c for w, c in count.items() if c >= 5}
    holes, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :], i].add(w)
    for (left, _), ws in holes.items():
        if left in n:
            for w in ws:
                near[left].add(w), near[w].add(left)
        for w in ws:
            near[w] |= ws - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("group", [2_000, 2])
def test_spelling_variants(spark, table, docs, empty, group):  # noqa: F811
    chain = [(k, " ".join(["wordform"] * 700 + ["wordforms"] * 130 + ["wordformss"] * 25 + ["xwordformss"] * 5 + ["Wérdform"] * 6)) for k in (1, None)]
    extra = spark.createDataFrame([*chain, (3, " ".join(f"{c}bcdefgh" for c in "abcdefghij" for _ in range(5)))], "doc_id long, text string")
    for df in (table, docs, extra, empty):
        want = variants_by_brute_force([(r.doc_id, r.text) for r in df.collect()])
        got = spelling.spelling_variants(df, group).collect()
        assert len(got) == len(want) and {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
        if df is extra:
            assert {w[2] for w in want if w[0] == "xwordformss"} == {"wordform"}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_scan_finds_what_is_one_edit_away():
    rng = np.random.default_rng(2)
    for _ in range(60):
        entries = sorted({"".join(rng.choice(list("abc"), rng.integers(0, 6))) for _ in range(70)})
        for query in [*entries[::4], "", "abcabcab"]:
            assert list(spelling.near_in_list(entries, query)) == [k for k, w in enumerate(entries) if edits(w, query) <= 1]


def test_scan_skips_ranges(monkeypatch):
    """Rows are made for shared beginnings once, and not at all beyond one that is too far."""
    entries = sorted(f"{a}{b}{c:03d}" for a in "abcdefgh" for b in "abcdefgh" for c in range(100))
    made, real = [0], spelling._next_row
    monkeypatch.setattr(spelling, "_next_row", lambda *a: (made.__setitem__(0, made[0] + 1), real(*a))[1])
    assert len(list(spelling.near_in_list(entries, "ab042"))) > 10 and made[0] < 0.15 * 5 * len(entries)


# 13 ----------------------------------------------------------------------------------------


def vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((60, 6)) @ np.diag([3, 2, 1.5, 1, 0.5, 0.1])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, rows[5][1]) for i in range(40)] + [rows[7], (None, rows[3][1])]
    bad = [None, [], [1.0] * 5, [1.0] * 5 + [None], [1.0] * 5 + [math.nan], [math.inf] + [0.0] * 5]
    return rows, rows + [(200 + i, v) for i, v in enumerate(bad)]


def test_whitening(spark):
    good, every = vectors(spark)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in every], "vec_id long, embedding array<float>, n int, x string").repartition(3)
    vec = whitening.integer_vectors(df)
    model = whitening.fit_whitening(vec)
    got = whitening.whiten(vec, model).collect()
    assert len(got) == 4 * len(good)
    x = [[math.floor(256 * c) for c in v] for _, v in good]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = [[Fraction(n * a - b, n) for a, b in zip(v, s)] for v in fit]
    cov = np.array([[float(sum(v[i] * v[j] for v in centred) / n) for j in range(6)] for i in range(6)])
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    white = collections.defaultdict(list)
    for (i, _), v in zip(good, x):
        y = [n * a - b for a, b in zip(v, s)]
        w = (np.array(y) / n) @ basis / np.sqrt(values)
        for k in range(4):
            white[i, k + 1].append((sum(c * c for c in y), abs(w[k]), values[k] / values.sum()))
    for r in got:
        near = white[r.vec_id, r.component]
        assert r.n == n and r.identity_error < 1e-9
        assert any(r.deviation == d and abs(abs(r.whitened) - w) < 1e-9 and abs(r.explained - e) < 1e-12 for d, w, e in near)


def test_covariance_comes_from_squares_of_sums(spark):
    rng = np.random.default_rng(4)
    for top in (300, 1 << 40):
        x = rng.integers(-top, top, (50, 5)) + np.array([0, top, -top, 7, 1])
        df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(3)
        n, sums = whitening.dimension_sums(df)
        centre = [(2 * s + n) // (2 * n) for s in sums]
        first, squares = whitening.squared_sums(df, centre)
        z = x.astype(object) - np.array(centre, dtype=object)
        assert sums == x.astype(object).sum(axis=0).tolist() and n == 50
        assert all(squares[i, j] == ((z[:, i] + z[:, j]) ** 2).sum() for i in range(5) for j in range(i + 1, 5))
        got = whitening.polarised_covariance(n, first, squares)
        exact = [[sum(Fraction(int(a)) * int(b) for a, b in zip(n * x.astype(object)[:, i] - sums[i], n * x.astype(object)[:, j] - sums[j])) / n**3 for j in range(5)] for i in range(5)]
        assert np.allclose(got, np.array(exact, dtype=float), rtol=1e-14)


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        v = whitening.integer_vectors(spark.createDataFrame(rows, schema))
        assert whitening.whiten(v, whitening.fit_whitening(v)).collect() == []
    v = whitening.integer_vectors(spark.createDataFrame([(1, [0.5, 3e38]), (2, [0.25, 0.0]), (None, [0.1, 1.0])], schema))
    got = whitening.whiten(v, whitening.fit_whitening(v)).collect()
    assert {r.vec_id for r in got} == {1, 2, None} and any(r.deviation is None for r in got)
