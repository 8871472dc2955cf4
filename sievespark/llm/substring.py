"""Removal of repeated 13-word passages by recompression.

Method: a document is a string of symbols, at first its words. A round names maximal
runs of a symbol, then pairs: every symbol is a left or a right one by a bit of its
name, and a left one followed by a right one becomes a pair. A name is a 64-bit hash
of what it stands for, so it is the same in all documents and partitions and a round
needs no dictionary and no shuffle. Whether a symbol arises depends on a few symbols
beside it only; each symbol carries the words that decide about it. A symbol whose
deciding words lie within a window is an interior symbol of that window, wherever
the window occurs.

Each window of ``LENGTH`` words is filed under its interior symbol of the highest
level (of several, the smallest name; under its own hash if it has none). Equal
windows meet under the same symbol, whatever surrounds them, and neighbouring windows
mostly stay together. There the hashes of all their words verify them: every window
that also starts in a document with a smaller id is marked, and the words it covers
are removed.

Scale: within about ``CHUNK_WORDS`` words of a task equal windows are resolved at
once, so a passage that a third of all documents share is sent once a chunk, not once a
document. What is left goes to buckets by symbol, packed as arrays, about
``BUCKET_WORDS`` words each; the bucket count follows the input. The texts are
shuffled once, to meet their marked places.

Cases: a null text has no words; a null id counts as larger than all ids, and equal
ids (repeated rows, null ids) aren't smaller than each other; documents shorter than a
window keep all words; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, with_text

LENGTH = 13
ROUNDS = 2
CHUNK_WORDS = 1_000_000
BUCKET_WORDS = 3_000_000

_FAR = 1 << 30
_NONE = np.uint64((1 << 64) - 1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Names(dict):
    """Hash of a word; forgets everything when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Symbols:
    """A level of the recompressed documents of a chunk.

    ``start`` is a symbol's first word; words from ``left`` to before ``right`` decide
    about it, or beyond any window where the end of a document does.
    """

    def __init__(self, name, doc, start, left, right):
        self.name, self.doc, self.start, self.left, self.right = name, doc, start, left, right

    def _beside(self) -> tuple[np.ndarray, np.ndarray]:
        """The left bound of the symbol before, the right bound of the symbol after."""
        before = np.where(np.append(False, self.doc[1:] == self.doc[:-1]), np.append(np.int32(0), self.left[:-1]), -_FAR)
        after = np.where(np.append(self.doc[1:] == self.doc[:-1], False), np.append(self.right[1:], np.int32(0)), _FAR)
        return before.astype(np.int32), after.astype(np.int32)

    def runs(self) -> Symbols:
        """Each maximal run of a symbol as one symbol."""
        before, after = self._beside()
        same = (self.name[1:] == self.name[:-1]) & (self.doc[1:] == self.doc[:-1])
        first = np.flatnonzero(np.append(True, ~same))
        last = np.append(first[1:], len(self.name)) - 1
        times = (last - first + 1).astype(np.uint64)
        name = np.where(times > 1, mix(self.name[first] + times * _PRIME), self.name[first])
        return Symbols(
            name, self.doc[first], self.start[first],
            np.minimum(self.left[first], before[first]), np.maximum(self.right[last], after[last]),
        )

    def pairs(self, level: int) -> Symbols:
        """Each left symbol before a right one together with it as one symbol."""
        before, after = self._beside()
        is_left = (mix(self.name ^ np.uint64(level)) & np.uint64(1)).astype(bool)
        opens = np.append(is_left[:-1] & ~is_left[1:] & (self.doc[1:] == self.doc[:-1]), False)
        first = np.flatnonzero(~np.append(False, opens[:-1]))
        pair = opens[first]
        second = np.where(pair, first + 1, first)
        name = np.where(pair, mix(mix(self.name[first] + np.uint64(level)) + self.name[second] * _PRIME), self.name[first])
        left = np.where(is_left, self.left, np.minimum(self.left, before))
        right = np.where(is_left, np.maximum(self.right, after), self.right)
        return Symbols(
            name, self.doc[first], self.start[first],
            np.minimum(left[first], left[second]), np.maximum(right[first], right[second]),
        )


def filed_under(words: np.ndarray, doc: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each window (by its first word), the name it is filed under; ``own`` are the windows' hashes."""
    n = len(own)
    at = np.arange(len(words), dtype=np.int32)
    level = Symbols(words, doc, at, at, at + np.int32(1))
    under = own.copy()
    window = np.arange(n, dtype=np.int32)
    for k in range(1, ROUNDS + 1):
        level = level.runs().pairs(k)
        name = np.full(len(words) + LENGTH, _NONE)
        left = np.full(len(words) + LENGTH, -_FAR, np.int32)
        right = np.full(len(words) + LENGTH, _FAR, np.int32)
        name[level.start], left[level.start], right[level.start] = mix(level.name), level.left, level.right
        best = np.full(n, _NONE)
        for d in range(LENGTH):
            inside = (left[d : d + n] >= window) & (right[d : d + n] <= window + LENGTH)
            np.minimum(best, np.where(inside, name[d : d + n], _NONE), out=best)
        under = np.where(best != _NONE, best, under)
    return under


def window_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the ``LENGTH`` words from each word on."""
    n = len(words) - LENGTH + 1
    h = np.zeros(max(n, 0), np.uint64)
    for d in range(LENGTH if n > 0 else 0):
        h = (h ^ words[d : d + n]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def _smallest(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window, the smallest document among those with its hash."""
    order = np.lexsort((doc, hashes))
    h, d = hashes[order], doc[order]
    head = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    out = np.empty_like(doc)
    out[order] = d[head][np.cumsum(head) - 1]
    return out


def _runs(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each stretch with one key and rising places."""
    head = np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    return first, np.diff(np.append(first, len(key)))


_SENT = "bucket long, hashes binary, docs binary, checks binary, of_doc binary, places binary, lengths binary"
_FIELDS = [c.split()[0] for c in _SENT.split(", ")]
_MARKED = "doc long, check long, place int, length int"


def _pack(bucket: int, hashes: np.ndarray, doc: np.ndarray, place: np.ndarray, ids: np.ndarray, checks: np.ndarray) -> list:
    """A row of stretches of windows; ``doc`` are numbers into ``ids`` and ``checks``."""
    first, length = _runs(doc, place)
    used, of_doc = np.unique(doc[first], return_inverse=True)
    return [
        bucket, hashes.tobytes(), ids[used].tobytes(), checks[used].astype(np.uint32).tobytes(),
        of_doc.astype(np.uint32).tobytes(), place[first].astype(np.uint32).tobytes(), length.astype(np.uint32).tobytes(),
    ]


def _chunk_rows(texts: list[list[bytes]], ids: np.ndarray, checks: np.ndarray, buckets: int, names: _Names) -> Iterator[list]:
    """Rows to send for the documents of a chunk: places already found, and windows to be looked up."""
    sizes = np.array([len(w) for w in texts], np.int64)
    words = np.fromiter((names[w] for t in texts for w in t), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    hashes = window_hashes(words)
    if not len(hashes):
        return
    first = np.cumsum(sizes) - sizes
    whole = doc[: len(hashes)] == doc[LENGTH - 1 :]
    under = filed_under(words, doc, hashes)[whole]
    at = np.flatnonzero(whole)
    doc, hashes = doc[at], hashes[at]
    place = at - first[doc]
    least = _smallest(hashes, ids[doc])
    known = ids[doc] > least
    if known.any():
        yield _pack(buckets + int(ids[0] ^ checks[0]) % buckets, np.zeros(0, np.uint64), doc[known], place[known], ids, checks)
    doc, place, hashes = doc[~known], place[~known], hashes[~known]
    bucket = (mix(under[~known]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1)) if buckets <= len(order) else None
    kept = range(buckets) if bounds is not None else np.unique(bucket).tolist()
    for b in kept:
        lo, hi = (bounds[b], bounds[b + 1]) if bounds is not None else np.searchsorted(bucket[order], [b, b + 1])
        own = order[lo:hi]
        if len(own):
            yield _pack(b, hashes[own], doc[own], place[own], ids, checks)


def sent(docs: DataFrame, buckets: int, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The windows of all documents, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, ids, checks, size = _Names(), [], [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            for row in _chunk_rows(texts, np.array(ids, np.int64), np.array(checks, np.int64), buckets, names):
                kinds = [pa.int64(), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], _FIELDS)

        for batch in batches:
            for d, c, t in zip(batch["doc"].to_pylist(), batch["check"].to_pylist(), batch["text"]):
                w = t.as_py().encode("utf-8", "replace").split()
                if len(w) < LENGTH:
                    continue
                texts.append(w)
                ids.append(d)
                checks.append(c)
                size += len(w)
                if size >= chunk_words:
                    yield from packed()
                    texts, ids, checks, size = [], [], [], 0
        if texts:
            yield from packed()

    return docs.mapInArrow(run, _SENT)


def _marked(table: pa.Table) -> pa.Table:
    """The windows of a bucket that also start in a smaller document, as stretches of places."""
    rows = table.to_pylist()
    parts = []
    for r in rows:
        of_doc = np.frombuffer(r["of_doc"], np.uint32)
        length = np.frombuffer(r["lengths"], np.uint32).astype(np.int64)
        doc = np.frombuffer(r["docs"], np.int64)[of_doc]
        check = np.frombuffer(r["checks"], np.uint32).astype(np.int64)[of_doc]
        parts.append((np.frombuffer(r["hashes"], np.uint64), doc, check, np.frombuffer(r["places"], np.uint32).astype(np.int64), length))
    hashes, doc, check, place, length = (np.concatenate(c) for c in zip(*parts))
    if len(hashes):
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        doc, check, place = np.repeat(doc, length), np.repeat(check, length), np.repeat(place, length) + inside
        found = doc > _smallest(hashes, doc)
        doc, check, place = doc[found], check[found], place[found]
        order = np.lexsort((place, check, doc))
        doc, check, place = doc[order], check[order], place[order]
        same = np.append(False, (doc[1:] == doc[:-1]) & (check[1:] == check[:-1])) if len(doc) else np.zeros(0, bool)
        first, length = _runs(np.cumsum(~same), place)
        doc, check, place = doc[first], check[first], place[first]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.Table.from_arrays([pa.array(c.astype(np.int64)).cast(t) for c, t in zip((doc, check, place, length), kinds)], ["doc", "check", "place", "length"])


def repeated_places(docs: DataFrame, bucket_words: int = BUCKET_WORDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc, check, place, length): ``length`` windows in a row, from word ``place`` on, that smaller documents hold too."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-chars // (6 * bucket_words)))
    return sent(docs, buckets, chunk_words).groupBy("bucket").applyInArrow(_marked, _MARKED)


def remove_repeats(
    docs: DataFrame, with_kept: bool = True, bucket_words: int = BUCKET_WORDS, chunk_words: int = CHUNK_WORDS
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked for, the ``kept`` text of every document."""
    keyed = with_text(docs).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.crc32(F.col("text").cast("binary")).alias("check")
    )
    places = repeated_places(keyed.select("doc", "check", "text"), bucket_words, chunk_words)
    spans = places.groupBy("doc", "check").agg(F.collect_list(F.struct("place", "length")).alias("spans"))
    joined = keyed.join(spans, ["doc", "check"], "left").select("doc_id", "text", "spans.place", "spans.length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, place, length in zip(batch["text"], batch["place"].to_pylist(), batch["length"].to_pylist()):
                words = text.as_py().encode("utf-8", "replace").split()
                n = len(words)
                if place:
                    edge = np.zeros(n + 1, np.int64)
                    begin = np.array(place)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + np.array(length) + LENGTH - 1, -1)
                    keep = np.cumsum(edge[:n]) == 0
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_kept else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *cols], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op1_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages removed from all documents; digest of what is kept."""
    return remove_repeats(documents(spark, sf_dir), with_kept=False).drop("kept")
