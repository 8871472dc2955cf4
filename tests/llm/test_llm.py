"""The training-data operators against brute force, over whole small tables and awkward rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash
from check_oracle import compare, connect
from pyspark.sql import functions as F

from sievespark.llm import (
    ans, components, decontam, fuzzy_lines, language, packing, pii, quality, queries, scoring, simhash, substring, tokens,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, part string, fp string, label int, words int"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def awkward():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, copies."""
    texts = [
        None, "", "   \n\t ", "a", "A b", f"{PASSAGE} tail of the first", f"head of the second {PASSAGE}",
        f"head of the second {PASSAGE}", "the " * 40, "word " * 20_000 + PASSAGE, "x" * 60_000,
        "mail me at jo.doe@mail.example.com or +1 (017) 555-7713, card 4111 1111 1111 1111, host 10.0.0.255 not 1.2.3.999",
        "Ünïcode größe ñandú\n漢字 テスト 🙂\r\nlast", "line one is here today\nline one is here today\nline two\n\n  ",
    ]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 2}", 5, "r", "p", "f", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[5], (None, PASSAGE, None, None, None, None, None, None, None, None), (None,) * 10, (5, "same id, other text", "en", "s", 1, "", "", "", 0, 0)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text):
    return WORD.findall(text or "")


# 1 -----------------------------------------------------------------------------------------


def repeats_by_brute_force(rows):
    out, seen, order = collections.Counter(), {}, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for doc_id, text in order:
        w = words(text)
        for i in range(len(w) - 12):
            seen.setdefault(tuple(w[i : i + 13]), doc_id if doc_id is not None else math.inf)
    for doc_id, text in order:
        w, own = words(text), doc_id if doc_id is not None else math.inf
        keep = [True] * len(w)
        for i in range(len(w) - 12):
            if seen[tuple(w[i : i + 13])] < own:
                keep[i : i + 13] = [False] * 13
        kept = " ".join(x for x, k in zip(w, keep) if k)
        out[doc_id, len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("sizes", [(3_000_000, 1_000_000), (2_000, 3_000)])
def test_substring(table, docs, sizes):
    for df in (table, docs):
        got = substring.remove_repeats(df, False, *sizes).drop("kept").collect()
        assert collections.Counter(map(tuple, got)) == repeats_by_brute_force([(r.doc_id, r.text) for r in df.collect()])


def test_substring_keeps_text(table):
    got = {r.doc_id: r.kept for r in substring.remove_repeats(table).collect()}
    assert got[6] == "head of the second" and got[5].endswith("tail of the first") or got[6] is not None


def test_symbols_of_equal_windows_agree():
    rng = np.random.default_rng(4)
    core = rng.integers(1, 4, 40).astype(np.uint64)
    under = []
    for k in range(30):
        own = np.concatenate([rng.integers(1, 4, k).astype(np.uint64), core, rng.integers(1, 4, 9).astype(np.uint64)])
        h = substring.window_hashes(own)
        under.append(substring.filed_under(own, np.zeros(len(own), np.int32), h)[k : k + 28].tolist())
    assert all(u == under[0] for u in under)


# 2 -----------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(n):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(n))) % 10 == 0


def base_spans(text):
    def good(kind, m):
        n = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        return luhn(n) if kind == "card" and 16 <= len(n) <= 19 else kind == "email" or kind == "phone" and 8 <= len(n) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if good(k, m.group(0))]


def personal(spark, df, monkeypatch):
    monkeypatch.setattr(pii, "documents", lambda *_: df)
    return pii.op2_candidate_boosting(spark, "").collect()


def test_personal_data(spark, table, docs, empty, monkeypatch):
    odd = [
        "a@b.c.d@e.f", "a@b a@b.c._x@y.z", "1.2.3.4.5.6.7.8", "0001.02.3.4", "256.1.1.1 1.1.1.256", "1" * 30, "4111-1111-1111-1111 2",
        "+1 23 +12345678 +1(2)3-4.5 678-", "é+49 170 1234567😀 a@b.de", "+1 2345678901234567", "4111 1111 1111 11114111 1111", "0" * 16,
    ]
    extra = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for df in (table, docs, extra, empty):
        text = {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}
        want = sorted((d is None, d or 0, hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()) for d, t in text)
        rows = personal(spark, df.dropDuplicates(["doc_id", "text"]), monkeypatch)
        assert sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256) for r in rows) == want
        for r in rows:
            assert r.n_email + r.n_ip + r.n_card + r.n_phone <= len([s for s in r.spans.split(",") if s])


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.de now"), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df, pii.personal_data(df)).collect()}
    assert got == {1: "mail [PII] now", 2: "nothing", 3: None}


def test_forms_beyond_the_strict_patterns_are_added(spark):
    """National phone numbers and written-out addresses go; numbers that are neither stay."""
    rng, rows = np.random.default_rng(3), []
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    for i in range(400):
        us, de = f"+1 ({n(3)}) {n(3)}-{n(4)}", f"+49 17{n(1)} {n(7)}"
        rows.append((i, f"please call {us} or phone {de} today, mail jo{i}@example{i % 7}.com now, order {n(9)} of {n(4)}-{n(4)}, user x{i}@home wrote"))
    planted = ["call (555) 123-4567 today", "phone 0170 1234567 today", "mail jo at example dot com now", "mail ann.lee (at) mail (dot) example (dot) org now"]
    kept = ["order 123456789 of it", "on 2024-05-17 12:30 and again", "we met at noon and dot the line"]
    rows += [(1000 + i, t) for i, t in enumerate(planted + kept)]
    got = {r.doc_id: [(x.kind, x.s, x.e) for x in r.added] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = [("phone", 5, 19), ("phone", 6, 18), ("email", 5, 26), ("email", 5, 46)]
    assert [got[1000 + i] for i in range(7)] == [[w] for w in want] + [[]] * 3


def test_trees_learn_from_every_labelled_candidate(spark):
    """A kind with 240 candidates among 60,000 has enough held-out ones for a threshold."""
    rare = F.col("id") % 250 == 0
    rows = spark.range(60_000).select(
        F.col("id").alias("row"), F.when(rare, "ip").otherwise("phone").alias("kind"), F.col("id").cast("int").alias("s"),
        F.when(rare, 1.0).otherwise((F.col("id") % 2).cast("double")).alias("label"),
        F.when(rare, 2.0).otherwise(4.0).alias("f_kind"), (F.col("id") % 2).cast("double").alias("f_odd"),
    )
    _, model, thresholds = pii.fit_trees(rows)
    assert set(thresholds) == {"ip", "phone"}
    assert model.getWeightCol() == "copies"


# 3 -----------------------------------------------------------------------------------------


def fingerprint(text):
    w = [("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)) for x in words(text)]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(items, near):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


def test_simhash(spark, table, docs, empty, monkeypatch):
    for df in (table, docs, empty):
        rows = df.select("doc_id", "text").collect()
        fps = [fingerprint(r.text) for r in rows]
        root = linked(fps, lambda a, b: (a ^ b).bit_count() <= 3)
        least = {c: min((r.doc_id for r, k in zip(rows, root) if k == c and r.doc_id is not None), default=None) for c in root}
        want = collections.Counter((r.doc_id, f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, root))
        monkeypatch.setattr(simhash, "documents", lambda *_, df=df: df)
        assert collections.Counter(map(tuple, simhash.op3_pivot_tables(spark, "").collect())) == want


def test_hot_groups_of_fingerprints_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 62, 4)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(150):
            f = int(c)
            for b in rng.choice(62, rng.integers(1, 5), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    fps = sorted(fps)
    root = linked(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    want = {frozenset(f for f, k in zip(fps, root) if k == c) for c in root}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for hot in (4, 64, 2048):
        got = components.components(simhash.links(df, hot=hot, group_rows=500)).collect()
        by = collections.defaultdict(set)
        for r in got:
            by[r.label].add(r.node)
        alone = {frozenset([f]) for f in set(fps) - {r.node for r in got}}
        assert {frozenset(v) for v in by.values()} | alone == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (900, 901), (902, 901)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500 and got[902] == got[901] == got[900] == 900
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4 -----------------------------------------------------------------------------------------


def normal(line):
    return re.sub(r"[ \t\x0b\x0c\r]+", " ", line.lower()).strip(" ")


def line_shingles(line):
    return all_shingles(line)


def lines_by_brute_force(rows):
    """{(doc, text): removed places} and the exact repeats among them."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    at = [(r, k, normal(line)) for r in rows for k, line in enumerate((r[1] or "").split("\n"))]
    at = [x for x in at if x[2]]
    lines = sorted({x[2] for x in at})
    sets = {x: line_shingles(x) for x in lines}

    def near(a, b):
        a, b = sets[a], sets[b]
        return min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)

    root = dict(zip(lines, linked(lines, near)))
    seen, out = set(), collections.defaultdict(set)
    for r, k, line in at:
        if root[line] in seen:
            out[r].add(k)
        seen.add(root[line])
    return out, len(at) - len(lines)


def test_fuzzy_lines(spark, table, docs, empty, monkeypatch):
    small = docs.where("doc_id < 60")
    for df in (table, small, empty):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want, exact = lines_by_brute_force(rows)
        monkeypatch.setattr(fuzzy_lines, "documents", lambda *_, df=df: df)
        got = fuzzy_lines.op4_fuzzy_lines(spark, "").collect()
        assert len(got) == len(rows)
        places = collections.Counter((r.doc_id, int(k)) for r in got for k in r.removed_lines.split(",") if k)
        true = collections.Counter((d, k) for (d, t) in rows for k in want.get((d, t), ()))
        assert not places - true and sum(places.values()) >= 0.9 * sum(true.values()) and sum(places.values()) >= exact


def test_fuzzy_lines_in_texts(spark):
    line = "The quick brown fox jumps over the lazy dog near the river bank every morning of the week"
    near = line.replace("lazy", "lazier") + " "
    rows = [(1, f"{line}\nown line of one"), (2, near), (3, f"{near.upper()}\nthird is different\n\n"), (4, ""), (5, None)]
    got = fuzzy_lines.keep_first_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {1: rows[0][1], 3: "third is different\n\n", 4: "", 5: None}


def test_band_of_unlike_lines_loses_no_link(spark):
    """Clusters that share bands, each unlike the bands' most frequent line, are still found."""
    rng = np.random.default_rng(6)
    common = [f"common{chr(97 + i)}" for i in range(20)]
    rows = []
    for cluster in range(6):
        own = ["".join(rng.choice(list("bcdfgklm"), 7)) for _ in range(14)]
        rows += [(10 * cluster + k, " ".join(common + own + [f"{'pqrs'[k]}end"])) for k in range(4)]
    df = fuzzy_lines.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    want, _ = lines_by_brute_force(rows)
    assert fuzzy_lines.removed_lines(df).count() == len(want) == 18


def test_variants_of_one_line_are_found_without_all_pairs(spark):
    words = [f"word{chr(97 + i)}{chr(97 + i)}" for i in range(26)]
    rows = [(0, " ".join(words)), (1, " ".join(words))]
    rows += [(2 + k, " ".join(words[:k] + ["changed" + "xyz"[k % 3]] + words[k + 1 :])) for k in range(26)]
    df = fuzzy_lines.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert fuzzy_lines.removed_lines(df).count() >= 26


def all_shingles(line):
    return frozenset([line[i : i + 5] for i in range(len(line) - 4)] or [line])


def all_links(lines, sets):
    """Lines linked by the Jaccard coefficient of all their 5-character shingles, by brute force."""
    return linked(lines, lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))


def test_fuzzy_lines_by_all_shingles(spark):
    """Addresses, ids and texts without spaces: only lines alike over all their characters go."""
    long = "https://www.example.org/articles/2024/05/a-rather-long-title-of-an-article-about-rivers"
    thai = "สวัสดีครับวันนี้อากาศดีมากเราไปเดินเล่นที่สวนสาธารณะกันเถอะ"
    lines = [
        "https://www.foo.org/abc", "https://www.bar.com/xyz/long/page", "inv-2024-00017", "inv-2024-99918",
        long, long + "-2", long.replace("https", "http"), "สวัสดีครับผมชื่อสมชายมาจากเชียงใหม่", thai, thai + "นะ",
        "extraordinarily unbelievable considerations", "extraordinary unbelievers considered",
        "a short line of few words", "a short line of few word", "漢字仮名交じり文は日本語の標準的な表記法である", "漢字仮名交じり文は日本語の標準的な表記法です",
    ]
    root = all_links(lines, {x: all_shingles(x) for x in lines})
    df = fuzzy_lines.keyed(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    got = {r.doc for r in fuzzy_lines.removed_lines(df).collect()}
    assert got == {i for i in range(len(lines)) if root[i] in root[:i]} and {0, 1, 2, 3, 7}.isdisjoint(got) and {5, 6, 9} <= got


def test_lines_of_one_template_are_all_compared(spark):
    """Partners that share only the bands of their template's words with thousands of unlike lines are found."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("bcdfgklmaeiou"), n))
    common, rows = [word(7) for _ in range(24)], []
    for k in range(400):
        own = [word(7) for _ in range(6)]
        other = [*own[:5], word(6)] if k % 2 else [own[0] + "s", *own[1:]]
        rows += [(2 * k + i, " ".join(common + w)) for i, w in enumerate((own, other))]
    rows = [(int(i), t) for i, t in rows]
    table = fuzzy_lines.line_table(fuzzy_lines.keyed(spark.createDataFrame(rows, "doc_id long, text string")))
    band = {r.doc: set(r.bands) for r in table.collect()}
    pairs = [k for k in range(400) if band[2 * k] & band[2 * k + 1]]
    sets = [all_shingles(t) for _, t in rows]
    assert all(5 * len(sets[0] & s) < 4 * len(sets[0] | s) for s in sets[2:])
    got = {r.doc for r in fuzzy_lines.removed_lines(fuzzy_lines.keyed(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    true = {2 * k + 1 for k in pairs if 5 * len(sets[2 * k] & sets[2 * k + 1]) >= 4 * len(sets[2 * k] | sets[2 * k + 1])}
    assert len(true) > 300 and true <= got


def test_lines_of_a_band_meet_by_what_is_rare_in_it(spark):
    """Each line goes under its shingles of smallest count in its key, so that lines of a template meet by their own words."""
    rng = np.random.default_rng(9)
    own = lambda n: ["".join(rng.choice(list("bcdfgklmaeiou"), 6)) for _ in range(n)]
    templates, rows = [own(12) for _ in range(8)], []
    for k, common in enumerate(templates):
        for i in range(40):
            w = own(5)
            rows += [(k, " ".join(common + w)), (k, " ".join(common + w[:4] + [w[4] + "x"]))] if i < 5 else [(k, " ".join(common + w))]
    members = spark.createDataFrame([(k, i, i) for i, (k, _) in enumerate(rows)], "key long, h long, label long")
    lines = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "h long, line string")
    sets = {r.h: set(r.s) for r in lines.select("h", fuzzy_lines.shingles(F.col("line")).alias("s")).collect()}
    count = collections.Counter((k, x) for i, (k, _) in enumerate(rows) for x in sets[i])
    met, prefix = collections.defaultdict(list), collections.defaultdict(list)
    for r in fuzzy_lines.rare_shingles(members, lines).collect():
        met[r.key, r.shingle].append(r.h)
        prefix[r.key, r.h].append((r.at, count[r.key, r.shingle]))
    for (k, h), got in prefix.items():
        rarest = sorted(count[k, x] for x in sets[h])[: len(sets[h]) - math.ceil(0.8 * len(sets[h])) + 1]
        assert sorted(got) == [(i, c) for i, c in enumerate(rarest) if c > 1]
    assert max(map(len, met.values())) < 20
    pairs = {(r.a, r.b) for r in fuzzy_lines.close_lines(members, lines).collect()}
    near = {(a, b) for a in sets for b in sets if a < b and rows[a][0] == rows[b][0] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(near) >= 40 and near <= pairs
    own_too = members.union(members.where("h % 2 = 0").selectExpr("key + 100", "h", "label"))
    clusters = {(r.key, r.h) for r in fuzzy_lines.band_clusters(own_too).collect()}
    assert len(clusters) == len(rows) and len({k for k, _ in clusters}) == len(templates)


def test_inner_white_space_makes_no_difference(spark):
    rows = [(0, "one two six ten a b c d e f g h"), (1, "one  two\tsix   ten a b\x0bc  d  e \t f  g h\r"), (2, " a b\nx\ty z"), (3, "x y\fz\na  b\n\t \r")]
    got = fuzzy_lines.removed_lines(fuzzy_lines.keyed(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {(r.doc, k) for r in got for k in r.removed} == {(1, 0), (3, 0), (3, 1)}


def test_sets_of_a_pair_are_built_once(spark):
    """Counted in the plan that Spark runs, where the condition moves into the join; and the limit itself is similar enough."""
    lines = spark.createDataFrame([(1, "abcdefghijklm"), (2, "abcdefghijklmno"), (3, "abcdefghijklmnop"), (4, "abcd"), (5, "abce")], "h long, line string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 5)], "a long, b long")
    found = fuzzy_lines._verified(pairs, lines)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2), (2, 3)]


def test_texts_are_normalised_once(spark):
    """Counted in the plan that Spark runs, for every line and for the candidates."""
    docs = fuzzy_lines.keyed(spark.createDataFrame([(1, "One line of words\n\n a  b"), (2, None)], "doc_id long, text string"))
    table = fuzzy_lines.line_table(docs)
    wanted = spark.createDataFrame([], "h long")
    for df in (table, fuzzy_lines.candidate_lines(docs, table.select("doc", "check", "place", "h"), wanted)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == plan.count("lower(") and 1 <= plan.count("split(") <= 2
    assert sorted((r.doc, r.place) for r in table.collect()) == [(1, 0), (1, 2)]


def test_pairs_are_ruled_out_by_sets_built_once_a_line(spark):
    """Of all pairs of a template's lines hardly any but the similar ones is left to be compared, and no similar one is lost."""
    rng = np.random.default_rng(10)
    own = lambda n: ["".join(rng.choice(list("bcdfgklmaeiou"), 6)) for _ in range(n)]
    common, texts = own(16), ["", "abcd", "abcdefghijklm", "abcdefghijklmno", "ab" * 400, "ab" * 900 + "c"]
    for i in range(20):
        w = own(6)
        texts += [" ".join(common + w), " ".join(common + w[:5] + [w[5] + "x" * (i + 1)])]
    long = own(9000)
    texts += [" ".join(long), " ".join(long[:-300]), " ".join(long[:4000])]
    sets = [all_shingles(t) for t in texts]
    everyone = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))]
    similar = {(a, b) for a, b in everyone if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    pairs = spark.createDataFrame(everyone, "a long, b long")
    lines = spark.createDataFrame(list(enumerate(texts)), "h long, line string")
    left = {tuple(r) for r in fuzzy_lines.possible(pairs, lines).collect()}
    assert len(similar) > 15 and similar <= left and len(left) < len(similar) + 0.02 * len(everyone)
    assert {tuple(r) for r in fuzzy_lines._verified(spark.createDataFrame(sorted(left), pairs.schema), lines).collect()} == similar


# 5 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [(1_000_000, 3_000_000), (3_000, 5_000)])
def test_language_model(table, docs, empty, sizes):
    for df in (table, docs, empty):
        rows = [(r.doc_id, [w.decode() for w in (r.text or "").encode().lower().split()] + [None]) for r in df.collect()]
        rest = lambda d: zlib.crc32(b"null" if d is None else str(d).encode()) % 7
        c = collections.Counter(t for d, w in rows if rest(d) != 2 for t in w)
        n, v = sum(c.values()), len(c)
        want = sorted(
            (d is None, d or 0, len(w), sum(c[t] > 0 for t in w), n, rest(d) == 2, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w), 6))
            for d, w in rows
        )
        got = scoring.score_texts(df, *sizes).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.held_out, round(r.base_score, 6)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
        if len(rows) > 100:
            held = [r for r in got if r.held_out]
            assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)


def interpolated_scores(rows, rounds=200):
    """doc_id -> log10 probability by EM over every token of the deleted fold, without a histogram."""
    text = {d: [None] + (t or "").encode().lower().split() + ["end"] for d, t in rows}
    fold = {d: zlib.crc32(str(d).encode()) % 7 for d in text}

    def estimates(folds):
        uni = collections.Counter(x for d, w in text.items() if fold[d] in folds for x in w)
        bi = collections.Counter(p for d, w in text.items() if fold[d] in folds for p in zip(w, w[1:]))
        n = sum(c for x, c in uni.items() if x is not None)
        return lambda u, v: (uni[u], bi[u, v] / uni[u] if uni[u] else 0.0, uni[v] / n)

    trained = [d for d in text if fold[d] != 2]
    floor = 1 / (len({x for d in trained for x in text[d][1:]}) + 1)
    main, every = estimates({0, 1, 4, 5, 6}), estimates({0, 1, 3, 4, 5, 6})
    tokens = collections.defaultdict(list)
    for d in trained:
        if fold[d] == 3:
            for u, v in zip(text[d], text[d][1:]):
                n, p2, p1 = main(u, v)
                tokens[n.bit_length()].append((p2, p1, floor))
    weights = {}
    for bucket, p in tokens.items():
        p, w = np.array(p), np.full(3, 1 / 3) if bucket else np.array([0.0, 0.5, 0.5])
        for _ in range(rounds):
            w = (w * p / (p @ w)[:, None]).mean(0)
            w = np.maximum(w, [1e-6 if bucket else 0.0, 1e-6, 1e-6])
            w /= w.sum()
        weights[bucket] = w
    seen = sorted(k for k in weights if k)
    out = {}
    for d, t in text.items():
        total = 0.0
        for u, v in zip(t, t[1:]):
            n, p2, p1 = every(u, v)
            k = n.bit_length()
            w = weights.get(0, np.array([0.0, 0.5, 0.5])) if k == 0 else weights[min(seen, key=lambda s: abs(s - k))]
            total += math.log10(w @ (p2, p1, floor))
        out[d] = total
    return out


def test_score_equals_brute_force_em(spark):
    rng = np.random.default_rng(5)
    starts = rng.integers(0, 40, (40, 4))
    rows = []
    for i in range(220):
        at, words_ = int(rng.integers(40)), []
        for _ in range(int(rng.integers(0, 60))):
            words_.append(f"w{at}")
            at = int(starts[at % 40, rng.integers(4)]) if rng.random() < 0.8 else int(rng.zipf(1.3)) % 300
        rows.append((i, " ".join(words_)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = interpolated_scores(rows)
    fine = {r.doc_id: r.score for r in scoring.score_texts(df, 900, 700, grid=1 << 14).collect()}
    assert max(abs(fine[d] - want[d]) for d in want) < 1e-6
    usual = {r.doc_id: r.score for r in scoring.score_texts(df).collect()}
    assert max(abs(usual[d] - want[d]) / max(1, abs(want[d])) for d in want) < 1e-3


@pytest.mark.parametrize("top", [1, 2**30, 2**60 - 1])
def test_keys_survive_as_differences(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, top, n, endpoint=True).astype(np.uint64))
        assert np.array_equal(scoring._keys(scoring._differences(keys)), keys)


def test_weights_recover_a_mixture():
    rng = np.random.default_rng(1)
    p = rng.random((4000, 2)) * 0.5 + 1e-3
    true = np.array([0.6, 0.3, 0.1])
    share = np.column_stack([p, np.full(len(p), 0.2)]) @ true
    cells = [dict(bucket=3, n=float(s) * 100, l2=math.log2(a) * s * 100, l1=math.log2(b) * s * 100, c2=1, c1=1) for (a, b), s in zip(p, share)]
    got = scoring.learn_weights(cells, 0.2)[3]
    assert got.sum() == pytest.approx(1) and got[0] > got[1] > 0


# 6 -----------------------------------------------------------------------------------------


def test_quality_on_awkward_rows(table, empty):
    got = quality.line_frequency_rules(table).collect()
    assert len(got) == table.count() and quality.line_frequency_rules(empty).count() == 0
    want = collections.Counter()
    for r in table.collect():
        w = words(r.text)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = collections.Counter(tri)
        repeat = len({i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)})
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        want[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), repeat] += 1
    assert collections.Counter(tuple(r)[:6] for r in got) == want


def test_boilerplate_is_counted_per_host(spark):
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    body = lambda i: " ".join(f"w{letters(i)}x{letters(k)}" for k in range(60))
    rows = [(i, f"Menu Home {i % 10}\n{body(i)}", "big") for i in range(40)] + [(100 + i, f"Menu home 1\n{body(100 + i)}", f"h{i}") for i in range(8)]
    rows += [(200 + i, " ".join(f"z{letters(k)}" for k in range(70)), "big") for i in range(15)]
    got = {r.doc_id: r for r in quality.line_frequency_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].n_words_left == 60 and got[i].kept for i in range(40))
    assert all(got[100 + i].n_words_left == 63 and got[100 + i].kept for i in range(8))
    assert not any(got[200 + i].kept for i in range(15))


def test_a_null_host_is_not_the_empty_host(spark):
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    body = lambda i: " ".join(f"w{letters(i)}x{letters(k)}" for k in range(60))
    rows = [(i, f"one shared menu\n{body(i)}", None if i % 2 else "") for i in range(16)]
    rows += [(100 + i, f"another shared menu\n{body(100 + i)}", None) for i in range(12)]
    rows += [(200 + i, body(200 + i), "=") for i in range(3)]
    got = {r.doc_id: r.n_words_left for r in quality.line_frequency_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {got[i] for i in range(16)} == {63} and {got[100 + i] for i in range(12)} == {60} and {got[200 + i] for i in range(3)} == {60}


def test_a_line_of_very_many_documents_goes_whatever_the_host_size(spark):
    """31 of 2,000 documents are under the ratio of 1 in 50, and over an absolute limit of 30; 30 are not."""
    rows = [(i, f"{'often' if i < 31 else 'less' if i < 61 else f'n{i}'} seen\nbody of {i}", "h") for i in range(2000)]
    rows = [(d, "".join("abcdefghij"[int(c)] if c.isdigit() else c for c in t), h) for d, t, h in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.n_words_left for r in quality.line_frequency_rules(df, max_docs=30).collect()}
    assert {got[i] for i in range(31)} == {3} and {got[i] for i in range(31, 2000)} == {5}


# 7, 10 -------------------------------------------------------------------------------------


def ids_of(name, text, end):
    e = tokens.encoder(name)
    return np.array(e.tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("name", [tokens.BYTE_FILE, tokens.WORD_FILE])
def test_parts_give_the_ids_of_the_whole_text(name):
    rng = np.random.default_rng(3)
    alphabet = list(" \n\t.,;:!?'aAbé漢1ß́ -\x01\x1cſİ　🙂")
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 60))) for _ in range(3000)]
    texts += ["a  b\n\n c \t d", "It's 'll don't", "<|endoftext|>. a", "", " ", "foo\r\nbar \r\n baz", "x" * 5000 + ". y", "word́. ǅx, ﬁn;"]
    e = tokens.Encoder(name)
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want


def check_packing(rows, df):
    left = collections.Counter()
    for r in df.collect():
        left[r.doc_id, ids_of(tokens.WORD_FILE, r.text, 2).tobytes()] += 1
    for (doc_id, raw), times in left.items():
        n = len(raw) // 4
        for start in range(0, n, 4096):
            crc = zlib.crc32(raw[4 * start : 4 * (start + 4096)])
            assert sum((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) == (doc_id, start, crc, n) for r in rows) >= times
    assert sum(r.length for r in rows) == sum(len(raw) // 4 * t for (_, raw), t in left.items())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length, r.tier, r.step_id))
    padded = total = 0
    for pieces in by.values():
        at = 0
        for offset, length, _, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= pieces[0][2] <= 4096 and len({p[2:] for p in pieces}) == 1
        padded += 0 if at & (at - 1) == 0 else 4096 - at
        total += at
    steps = collections.Counter()
    for s in {(k, *v[0][2:]) for k, v in by.items()}:
        steps[s[2]] += s[1]
    assert all(v <= packing.STEP_TOKENS for v in steps.values())
    return padded / max(total, 1)


def test_packing(table, docs, empty):
    check_packing(packing.pack(table).collect(), table)
    assert check_packing(packing.pack(docs).collect(), docs) < 0.05
    assert packing.pack(empty).count() == 0


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(5)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 4097, 900), rng.integers(1, 50, 900))}
    plan = packing.plan_windows(counts)
    fill = np.zeros(plan.sequences, int)
    for n, c in counts.items():
        slots = sorted(plan.slots[n])
        assert slots[0][0] == 0
        for (lo, times, first, _), hi in zip(slots, [s[0] for s in slots[1:]] + [c]):
            for k in range(hi - lo):
                fill[first + k // times] += n
    assert fill.max() <= 4096 and fill.sum() == sum(n * c for n, c in counts.items())
    short = fill[(fill & (fill - 1)) != 0]
    assert (4096 - short).sum() < 0.01 * fill.sum()


@pytest.mark.parametrize("segment", [4_000_000, 20_000])
def test_coded_files(spark, table, docs, empty, tmp_path, segment):
    for k, df in enumerate((table, docs, empty)):
        ans.write_ids(df, f"{tmp_path}/{k}", segment=segment)
        got = ans.documents_read(spark, f"{tmp_path}/{k}").collect()
        want = sorted(((r.doc_id is not None, r.doc_id or 0, ids_of(tokens.BYTE_FILE, r.text, 0)) for r in df.collect()), key=lambda x: x[:2])
        assert collections.Counter((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter(
            (a, b, len(x), zlib.crc32(x.tobytes())) for a, b, x in want
        )
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
        assert order == sorted(order)


@pytest.mark.parametrize("n", [1, 31, 16_384, 16_385, 70_000])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50_257).astype(np.uint32)
    payload = ans.encode(ids)
    assert (ans.decode(payload) == ids).all()
    last = (n - 1) // ans.BLOCK
    assert (ans.decode(payload, [last]) == ids[last * ans.BLOCK :]).all()
    broken = bytearray(payload)
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        ans.decode(bytes(broken))


# 8 -----------------------------------------------------------------------------------------


def test_fit_copies_no_matrix():
    """Fitting takes little of the driver's memory beside the features it is given."""
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(1600, language.WIDTH))).astype(np.float32)
    labels = [f"l{i % 4}" for i in range(len(x))]
    x[np.arange(len(x)), np.arange(len(x)) % 4] += 20
    tracemalloc.start()
    model = language.fit(x, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.8 * x.nbytes
    assert [model.langs[i] for i in model.predict(x)[0]] == labels


def test_language(spark, sf_dir, table, empty):
    got = language.op8_family_then_svm(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) > 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    model = language.learn_languages(table)
    rows = language.identify(table, model, "doc_id", "text").collect()
    assert len(rows) == table.count()
    assert all((r.lang_pred == "und") == (not language.has_letter(r.text)) for r in rows)
    assert language.learn_languages(empty) is None and language.identify(empty, None, "doc_id").count() == 0
    assert {r.lang_pred for r in language.identify(table, None, "doc_id").collect()} == {"und"}


# 9 -----------------------------------------------------------------------------------------


def test_benchmark_items(spark, table, empty, sf_dir):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "too short"), (5, "absent words " * 9), (None, PASSAGE)], "item_id long, text string")
    for chars in (8_000_000, 100):
        got = {(r.doc_id, r.item_id, r.n_matched, r.first_word) for r in decontam.find_items(table, items, "doc_id", block_chars=chars).collect()}
        assert got == {(d, i, 15, w) for d, w in ((5, 0), (6, 4), (7, 4), (9, 20_000), (None, 0)) for i in (1, None)}
    assert decontam.find_items(empty, items, "doc_id").count() == 0
    assert decontam.find_items(table, items.limit(0), "doc_id").count() == 0
    left = decontam.keep_clean(table, items)
    assert left.count() == table.count() - 6 and left.columns == table.columns


def test_replaced_words_are_borne(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    rng, rows = np.random.default_rng(2), []
    for r in bench:
        w = r.text.split()
        for i in rng.choice(len(w), len(w) // 10, replace=False):
            w[i] = f"new{i}"
        rows.append((r.item_id, "before it comes this " + " ".join(w) + " and after it that"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = decontam.find_items(df, items, "doc_id").collect()
    assert len({r.doc_id for r in got if r.doc_id == r.item_id}) >= 0.95 * len(bench) and all(r.doc_id == r.item_id for r in got)


def test_items_against_brute_force(spark, docs, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    tok = lambda t: re.findall(r"\w+", t.lower())
    want = set()
    for i in bench.collect():
        w = tok(i.text)
        n = min(13, -(-len(w) * 4 // 5))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        want |= {(d.doc_id, i.item_id) for d in docs.collect() for v in [tok(d.text)] if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1))}
    assert {(r.doc_id, r.item_id) for r in decontam.find_items(docs, bench, "doc_id").collect()} == want


def test_short_items_with_replaced_words(spark):
    """Items of 1 to 16 words bear any choice of replaced words within their share, and no more."""
    import itertools

    items, rows, want = [], [], set()
    for n in range(1, 17):
        w = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(w)))
        for r in range(4):
            for out in itertools.combinations(range(n), r):
                for edge in ("", "before it "):
                    text = [f"new{i}" if i in out else x for i, x in enumerate(w)]
                    rows.append((len(rows), edge + " ".join(text)))
                    if 5 * (n - r) >= 4 * n:
                        want.add((len(rows) - 1, n))
    items += [(20, "漢字仮名交じり文"), (21, "มานะมานีปิติชูใจ"), (22, "yes")]
    rows += [(len(rows), "前漢字仮名変じり文後"), (len(rows) + 1, "ดูมานะมานีปิติชูใจนะ"), (len(rows) + 2, "yes yes no yes")]
    want |= {(rows[-3][0], 20), (rows[-2][0], 21), (rows[-1][0], 22)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.find_items(df, spark.createDataFrame(items, "item_id long, text string"), "doc_id").collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


# all ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), sf_dir, name)[0] is None


def test_a_query_for_each_operator():
    import __spark_entry__ as registered

    names = [q for q in registered.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in names) == list(range(1, 14))
