"""Benchmark decontamination by spaced-seed hashing.

Method: fixed masks select some of the words of a window and ignore the others, so
a window still matches where ignored words were replaced. Seeds of all windows of
the benchmark are looked up by the seeds of the documents. Around every hit, the
document and the item are laid on each other at the hit's offset, and the segment
with the best score (2 for an equal word, -3 for a replaced one) is taken. An item
is found in a document if that segment has at least 13 equal words, or, if the item
is short, if at least 0.8 of its words are equal at that offset. Short items have
further masks, so that no choice of replaced words within that share hides them;
items of fewer than ``MIN_ITEM`` words bear none and are found as they are.

Words are runs of letters, digits and underscores, in lower case; a letter of a
script without spaces is a word.

Scale: documents are read once for every ``BLOCK_CHARS`` characters of benchmark and
are not shuffled; each task holds the seeds of one block, whose size is checked, so
memory doesn't follow the benchmark's size either. Seeds pass a bit table before
they are searched for.

Cases: null or empty texts on either side match nothing; repeated rows are reported
each; an empty table on either side gives no rows; extra columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .tokens import text_groups

#: Each has six words; together they bear a replaced word in any place, also one word in five.
MASKS = ("1110111", "11011011", "110100111", "1111000011")
MIN_ITEM = 5
MIN_WORDS = 13
MIN_SHARE = 0.8
#: Items of so many words at most are found by their share.
SHORT = 16
BLOCK_CHARS = 8_000_000
_TABLE_BITS = 22

#: Ideographs and kana, and the letters of Thai, Lao, Burmese and Khmer.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORDS = re.compile(rf"[^\W{_UNSPACED}]+|(?=\w)[{_UNSPACED}]").findall
_FACTORS = np.random.default_rng(9).integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    """Hash of a word; forgets everything when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


def word_hashes(text: str, known: _Hashes) -> np.ndarray:
    words = _WORDS(text.lower())
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed that starts at each word, as far as the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, hash_of_mask(mask), np.uint64)
    for k, o in enumerate(i for i, c in enumerate(mask) if c == "1"):
        h += words[o : o + n] * _FACTORS[k]
        h ^= h >> np.uint64(29)
    return h * np.uint64(0x9E3779B97F4A7C15)


def hash_of_mask(mask: str) -> int:
    return xxhash.xxh3_64_intdigest(mask.encode())


def needed(n: int) -> int:
    """The equal words by which an item of n words is found."""
    return min(MIN_WORDS, -(-n * 4 // 5))


def masks_of(n: int) -> list[str]:
    """The masks for items of n words: one of them holds wherever ``n - needed(n)`` words of a short item are replaced."""
    if n < MIN_ITEM:
        return ["1" * n]
    if n < 9:  # one word may differ: all but each; one mask serves for the first and the last
        return ["1" * (n - 1), *("1" * i + "0" + "1" * (n - 1 - i) for i in range(1, n - 1))]
    lost = n - needed(n)
    if lost < 2 or n > SHORT:
        return list(MASKS)
    # Of lost + 2 blocks two are whole.
    cuts = [n * i // (lost + 2) for i in range(lost + 3)]
    block = [next(b for b in range(lost + 2) if i < cuts[b + 1]) for i in range(n)]
    pairs = itertools.combinations(range(lost + 2), 2)
    return [*MASKS, *("".join("1" if b in two else "0" for b in block).strip("0") for two in pairs)]


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        known = _Hashes()
        self.items = [(i, w) for i, t in items for w in [word_hashes(t, known)] if len(w)]
        of = {n: masks_of(n) for n in {len(w) for _, w in self.items}}
        self.masks = sorted({m for masks in of.values() for m in masks})
        self.length = np.array([len(w) for _, w in self.items], int)
        found = []
        for k, (_, w) in enumerate(self.items):
            for m in of[len(w)]:
                s = seeds(w, m)
                found.append((s, np.full(len(s), k), np.arange(len(s))))
        parts = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.uint64), *[np.zeros(0, int)] * 2]
        order = np.argsort(parts[0], kind="stable")
        self.seed, self.item, self.at = (p[order] for p in parts)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.seed >> np.uint64(64 - _TABLE_BITS)] = True

    def search(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, equal words, words of the item, first word in the document), the best place of each pair."""
        if not docs or not self.items:
            return []
        words = np.concatenate(docs)
        first = np.cumsum([0, *map(len, docs)])
        places = []
        for m in self.masks:
            s = seeds(words, m)
            p = np.flatnonzero(self.table[s >> np.uint64(64 - _TABLE_BITS)]) if len(s) else np.zeros(0, int)
            lo, hi = np.searchsorted(self.seed, s[p], "left"), np.searchsorted(self.seed, s[p], "right")
            n = hi - lo
            p, lo, n = p[n > 0], lo[n > 0], n[n > 0]
            entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            p = np.repeat(p, n)
            doc = np.searchsorted(first, p, "right") - 1
            places.append(np.unique(np.stack([doc, self.item[entry], p - self.at[entry]], 1), axis=0))
        places = np.unique(np.concatenate(places), axis=0)
        # The smallest items must be equal as a whole, so that their first place within a document says all.
        doc, item, shift = places.T
        small = self.length[item] < MIN_ITEM
        whole = places[small & (shift >= first[doc]) & (shift + self.length[item] <= first[doc + 1])]
        whole = whole[np.unique(whole[:, :2], axis=0, return_index=True)[1]]
        places = np.concatenate([places[~small], whole])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for d, k, shift in places.tolist():
            item = self.items[k][1]
            a, b = max(shift, int(first[d])), min(shift + len(item), int(first[d + 1]))
            if b <= a:
                continue
            same = words[a:b] == item[a - shift : b - shift]
            total = np.concatenate([[0], np.cumsum(np.where(same, 2, -3))])
            end = int((total - np.minimum.accumulate(total)).argmax())
            begin = int(total[: end + 1].argmin())
            equal = int(same[begin:end].sum())
            if equal < needed(len(item)) and len(item) <= SHORT:
                begin, equal = int(same.argmax()), int(same.sum())
            if equal >= needed(len(item)) and equal > best.get((d, k), (0, 0))[0]:
                best[d, k] = (equal, a + begin - int(first[d]))
        return [(d, k, n, len(self.items[k][1]), at) for (d, k), (n, at) in sorted(best.items())]


def find_items(docs: DataFrame, benchmark: DataFrame, *keep: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and benchmark item found in it, with the columns ``keep`` of the document."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    types = dict(docs.dtypes)
    out = "item_id long, n_matched long, n_item_words long, first_word long"
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [out])
    found = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        index = docs.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in own.collect()]))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = _Hashes()
            for batch in batches:
                at, hits = 0, []
                for group in text_groups(batch["text"].to_pylist()):
                    got = index.value.search([word_hashes(t, known) for t in group])
                    hits += [(at + d, index.value.items[k][0], *rest) for d, k, *rest in got]
                    at += len(group)
                rows = pa.array([h[0] for h in hits], pa.int64())
                cols = [batch[c].take(rows) for c in keep]
                cols += [pa.array([h[i] for h in hits], pa.int64()) for i in range(1, 5)]
                yield pa.RecordBatch.from_arrays(cols, [*keep, *[c.split()[0] for c in out.split(", ")]])

        part = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found."""
    own = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn(
        "_check", F.xxhash64(F.coalesce("text", F.lit("")))
    )
    hit = find_items(own, benchmark, "_doc", "_check").select("_doc", "_check").distinct()
    return own.join(hit, ["_doc", "_check"], "left_anti").drop("_doc", "_check")


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that stands in a document, in order of neither."""
    docs = documents(spark, sf_dir)
    return find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "doc_id")
