"""Language-model scores by deleted interpolation of bigrams, words and a floor.

Method: P(v | u) = a2 c(u v) / c(u) + a1 c(v) / N + a0 / (V + 1), with maximum-likelihood
estimates from the training documents. The weights depend on a bucket of the
context's frequency (a power of two) and are learned by expectation-maximisation:
one fold of the training documents is deleted, the estimates are taken from the
rest, and the weights are those that make the deleted fold likeliest. The model then
scores with the counts of all training documents. An unknown word has the floor only;
the probabilities of a context's followers, unknown words as one, sum to 1.

Scale: about ``CHUNK_WORDS`` words of one fold form a chunk, a row of compressed texts.
A chunk asks for the counts of its distinct words and bigrams, packed as sorted arrays
in key ranges; a range is summed in one task and answers each chunk in the chunk's
order, so answers need no keys. A frequent word or bigram is one entry a chunk, however
often it occurs. The number of ranges follows the input. EM runs on a histogram of
the deleted fold's tokens (bucket, bigram estimate, word estimate on a logarithmic
grid, with the mean in each cell), whose size doesn't follow the input; each bucket's
weights are learned in a task of their own, and only they reach the driver.

Words are keyed by 64 bits of a hash, bigrams by 60 (of a thousand million distinct
bigrams fewer than one pair is expected to agree). Whole keys are sent, as the
differences of the sorted keys in as many bytes as the largest needs.

Cases: a null text is empty and has the end token only; repeated rows each get a row;
without training documents N and V are 0 and every token has the floor; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import materialize
from .common import documents, id_remainder_py, with_text

MODULUS, HELD_OUT, DELETED = 7, 2, 3
CHUNK_WORDS = 700_000
RANGE_KEYS = 2_000_000
GRID = 8  # cells of the EM histogram per factor of two
EM_ROUNDS = 200

MAIN, LEFT_OUT, TEST = 0, 1, 2

_START = np.uint64(0x243F6A8885A308D3)
_END = np.uint64(0x13198A2E03707344)
_BI_BITS = 60


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CHUNK = "chunk long, fold int, n_tokens long, doc_ids binary, null_ids binary, texts binary"


def chunks(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Rows of about ``chunk_words`` words of documents of one fold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        held: dict[int, list] = {k: [[], [], 0] for k in (MAIN, LEFT_OUT, TEST)}
        made, part = 0, 0

        def row(fold: int) -> pa.RecordBatch:
            ids, texts, n = held[fold]
            held[fold] = [[], [], 0]
            blob = np.array([len(t) for t in texts], "<i8").tobytes() + b"".join(texts)
            values = [
                (part << 32) + made, fold, n, np.array([i or 0 for i in ids], "<i8").tobytes(),
                np.array([i is None for i in ids], bool).tobytes(), pack.compress(blob),
            ]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], [c.split()[0] for c in _CHUNK.split(", ")])

        for batch in batches:
            for p, i, t in zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                part, rest = p, id_remainder_py(i, MODULUS)
                fold = TEST if rest == HELD_OUT else LEFT_OUT if rest == DELETED else MAIN
                raw = t.encode("utf-8", "replace").lower()
                own = held[fold]
                own[0].append(i)
                own[1].append(raw)
                own[2] += len(raw.split()) + 1
                if own[2] >= chunk_words:
                    yield row(fold)
                    made += 1
        for fold in held:
            if held[fold][0]:
                yield row(fold)
                made += 1

    return docs.withColumn("part", F.spark_partition_id()).select("part", "doc_id", "text").mapInArrow(run, _CHUNK)


class Chunk:
    """A chunk's tokens as places in its sorted distinct keys."""

    def __init__(self, doc_ids: bytes, null_ids: bytes, texts: bytes):
        blob = zstandard.ZstdDecompressor().decompress(texts)
        none = np.frombuffer(null_ids, bool)
        self.ids = [None if z else i for i, z in zip(np.frombuffer(doc_ids, "<i8").tolist(), none.tolist())]
        n = len(self.ids)
        ends = np.cumsum(np.frombuffer(blob, "<i8", n)) + 8 * n
        starts = ends - np.frombuffer(blob, "<i8", n)
        known, words = _Hashes(), []
        for s, e in zip(starts.tolist(), ends.tolist()):
            w = blob[s:e].split()
            words.append(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)))
        self.sizes = np.array([len(w) + 1 for w in words], np.int64)
        tokens = np.concatenate([x for w in words for x in (w, np.array([_END]))])
        before = np.append(_START, tokens[:-1])
        before[np.cumsum(self.sizes)[:-1]] = _START
        # The start is asked for as a word too: its count is the number of documents.
        self.uni, place = np.unique(np.concatenate([tokens, before[before == _START]]), return_inverse=True)
        self.token = place[: len(tokens)]
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[before == _START] = np.searchsorted(self.uni, _START)
        self.uni_n = np.bincount(place, minlength=len(self.uni))
        pairs = _mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens) >> np.uint64(64 - _BI_BITS)
        self.bi, self.pair, self.bi_n = np.unique(pairs, return_inverse=True, return_counts=True)


def _planes(n: np.ndarray) -> bytes:
    """Counts as unsigned 32-bit numbers, first bytes first, which compress well as most counts are small."""
    return n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _differences(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, of one width, first bytes first; the width is the first byte."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _keys(packed: bytes) -> np.ndarray:
    if not packed:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(packed, np.uint8, offset=1).reshape(packed[0], -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : packed[0]] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _bounds(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    edges = np.array([(r << bits) // ranges for r in range(ranges)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


_ASK = "range long, chunk long, fold int, uni binary, uni_n binary, bi binary, bi_n binary"


def questions(stage: DataFrame, ranges: int) -> DataFrame:
    """What each chunk asks of each range of keys, with its own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk(r["doc_ids"], r["null_ids"], r["texts"])
                u, b = _bounds(c.uni, 64, ranges), _bounds(c.bi, _BI_BITS, ranges)
                rows = []
                for k in range(ranges):
                    x, y = slice(u[k], u[k + 1]), slice(b[k], b[k + 1])
                    if x.stop > x.start or y.stop > y.start:
                        # From the range's start, so that the first difference is no larger than the rest.
                        bi = _differences(c.bi[y] - np.uint64((k << _BI_BITS) // ranges))
                        rows.append((k, r["chunk"], r["fold"], c.uni[x].tobytes(), _planes(c.uni_n[x]), bi, _planes(c.bi_n[y])))
                kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows), kinds)], [c.split()[0] for c in _ASK.split(", ")])

    return stage.mapInArrow(run, _ASK)


_ANSWER = "range long, chunk long, fold int, uni binary, bi binary, vocabulary long"


def _answers(table: pa.Table) -> pa.Table:
    """For each chunk, the counts of its keys in its order; ``vocabulary``: trained words of the range, in one row.

    A chunk of the left-out fold gets the counts in the main fold before those in all training documents.
    """
    rows = table.to_pylist()
    trained = {}
    out: dict[str, list] = {"uni": [], "bi": []}
    for kind, keys in (("uni", [np.frombuffer(r["uni"], np.uint64) for r in rows]), ("bi", [_keys(r["bi"]) for r in rows])):
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate([_numbers(r[kind + "_n"]) for r in rows])
        fold = np.repeat(np.array([r["fold"] for r in rows], np.int8), [len(k) for k in keys])
        main = np.bincount(place, np.where(fold == MAIN, n, 0), len(distinct))
        every = main + np.bincount(place, np.where(fold == LEFT_OUT, n, 0), len(distinct))
        if every.max(initial=0) >= 2**32:
            raise ValueError("a count exceeds 32 bits")
        if kind == "uni":
            trained = int(((every > 0) & (distinct != _START)).sum())
        ends = np.cumsum([len(k) for k in keys])
        for r, e, k in zip(rows, ends, keys):
            own = place[e - len(k) : e]
            out[kind].append((_planes(main[own]) if r["fold"] == LEFT_OUT else b"") + _planes(every[own]))
    return pa.table(
        [
            pa.array([r["range"] for r in rows], pa.int64()), pa.array([r["chunk"] for r in rows], pa.int64()),
            pa.array([r["fold"] for r in rows], pa.int32()), pa.array(out["uni"], pa.binary()), pa.array(out["bi"], pa.binary()),
            pa.array([trained] + [0] * (len(rows) - 1), pa.int64()),
        ],
        names=[c.split()[0] for c in _ANSWER.split(", ")],
    )


def _counts(answers: pa.Table, main: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a chunk's words and bigrams in all training documents, or in the main fold."""
    rows = sorted(answers.select(["range", "fold", "uni", "bi"]).to_pylist(), key=lambda r: r["range"])

    def wanted(r: dict, kind: str) -> np.ndarray:
        if r["fold"] != LEFT_OUT:
            return _numbers(r[kind])
        half = len(r[kind]) // 2
        return _numbers(r[kind][:half] if main else r[kind][half:])

    return tuple(np.concatenate([wanted(r, kind) for r in rows]).astype(np.float64) for kind in ("uni", "bi"))


def frequency_bucket(n: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2 n)."""
    return np.frexp(n)[1]


def _cell(p: np.ndarray, grid: int) -> np.ndarray:
    """Place of a probability on the logarithmic grid; -1 for 0."""
    return np.where(p > 0, np.floor(-np.log2(np.maximum(p, 1e-300)) * grid), -1).astype(np.int64)


def learn_weights(cells: list, n_floor: float, rounds: int = EM_ROUNDS) -> dict[int, np.ndarray]:
    """(a2, a1, a0) for each bucket by EM on rows (bucket, n, log2 p2 sum, log2 p1 sum, has p2, has p1)."""
    weights = {}
    by: dict[int, list] = {}
    for r in cells:
        by.setdefault(r["bucket"], []).append(r)
    for bucket, rows in by.items():
        n = np.array([r["n"] for r in rows], float)
        p = np.stack(
            [
                np.array([2.0 ** (r["l2"] / r["n"]) if r["c2"] >= 0 else 0.0 for r in rows]),
                np.array([2.0 ** (r["l1"] / r["n"]) if r["c1"] >= 0 else 0.0 for r in rows]),
                np.full(len(rows), n_floor),
            ],
            1,
        )
        w = np.array([0.0, 0.5, 0.5]) if bucket == 0 else np.full(3, 1 / 3)
        for _ in range(rounds):
            share = w * p
            share /= share.sum(1, keepdims=True)
            w = (n[:, None] * share).sum(0) / n.sum()
            # Every estimate keeps some weight, so that no text is impossible.
            w = np.maximum(w, [0.0 if bucket == 0 else 1e-6, 1e-6, 1e-6])
            w /= w.sum()
        weights[bucket] = w
    return weights


def weights_of(weights: dict[int, np.ndarray], buckets: np.ndarray) -> np.ndarray:
    """The weights for each bucket; one without deleted tokens takes the nearest learned one's, an unseen context no bigrams."""
    seen = sorted(k for k in weights if k)
    table = np.zeros((int(buckets.max(initial=0)) + 1, 3))
    for k in range(len(table)):
        if k == 0:
            table[k] = weights.get(0, np.array([0.0, 0.5, 0.5]))
        else:
            table[k] = weights[min(seen, key=lambda s: abs(s - k))] if seen else np.full(3, 1 / 3)
    return table[buckets]


def score_texts(
    docs: DataFrame, chunk_words: int = CHUNK_WORDS, range_keys: int = RANGE_KEYS, grid: int = GRID
) -> DataFrame:
    """One row per document with its token counts, the base score and the model's score."""
    stage = materialize(chunks(with_text(docs), chunk_words), "lm-chunks")
    sizes = {r["fold"]: r["n"] for r in stage.groupBy("fold").agg(F.sum("n_tokens").alias("n")).collect()}
    n_main, n_left = float(sizes.get(MAIN, 0)), float(sizes.get(LEFT_OUT, 0))
    ranges = max(1, -(-sum(sizes.values()) // range_keys))
    answers = materialize(questions(stage, ranges).groupBy("range").applyInArrow(_answers, _ANSWER), "lm-counts")
    vocabulary = float(answers.agg(F.sum("vocabulary")).first()[0] or 0)
    floor = 1 / (vocabulary + 1)

    def histogram(asked: pa.Table, answered: pa.Table) -> pa.Table:
        r = asked.to_pylist()[0]
        c = Chunk(r["doc_ids"], r["null_ids"], r["texts"])
        uni, bi = _counts(answered, main=True)
        context = uni[c.context]
        p2 = np.divide(bi[c.pair], context, out=np.zeros(len(context)), where=context > 0)
        p1 = uni[c.token] / max(n_main, 1)
        keys = (frequency_bucket(context).astype(np.int64) << 40) | (_cell(p2, grid) + 1 << 20) | (_cell(p1, grid) + 1)
        cells, place = np.unique(keys, return_inverse=True)
        low = (1 << 20) - 1
        log = lambda p: np.log2(np.where(p > 0, p, 1.0))
        return pa.table(
            {
                "bucket": cells >> 40, "c2": (cells >> 20 & low) - 1, "c1": (cells & low) - 1,
                "n": np.bincount(place).astype(np.int64), "l2": np.bincount(place, log(p2)), "l1": np.bincount(place, log(p1)),
            }
        )

    def group(df: DataFrame):
        return df.groupBy("chunk")

    of_left = F.col("fold") == LEFT_OUT
    cells = group(stage.where(of_left)).cogroup(group(answers.where(of_left))).applyInArrow(
        histogram, "bucket long, c2 long, c1 long, n long, l2 double, l1 double"
    )
    cells = cells.groupBy("bucket", "c2", "c1").agg(*[F.sum(x).alias(x) for x in ("n", "l2", "l1")])

    def learn(table: pa.Table) -> pa.Table:
        ((bucket, w),) = learn_weights(table.to_pylist(), floor).items()
        return pa.table({"bucket": [bucket], "w": pa.array([w.tolist()], pa.list_(pa.float64()))})

    learned = cells.groupBy("bucket").applyInArrow(learn, "bucket long, w array<double>").collect()  # a row per power of two
    weights = {r["bucket"]: np.array(r["w"]) for r in learned}

    n_all = n_main + n_left

    def score(asked: pa.Table, answered: pa.Table) -> pa.Table:
        r = asked.to_pylist()[0]
        c = Chunk(r["doc_ids"], r["null_ids"], r["texts"])
        uni, bi = _counts(answered)
        context, count = uni[c.context], uni[c.token]
        p2 = np.divide(bi[c.pair], context, out=np.zeros(len(context)), where=context > 0)
        w = weights_of(weights, frequency_bucket(context))
        p = w[:, 0] * p2 + w[:, 1] * count / max(n_all, 1) + w[:, 2] * floor
        first = np.cumsum(c.sizes) - c.sizes
        base = np.log10((count + 1) / (n_all + vocabulary + 1))
        return pa.table(
            [
                pa.array(c.ids, pa.int64()), pa.array([r["fold"] == TEST] * len(c.ids)), pa.array(c.sizes),
                pa.array(np.add.reduceat((count > 0).astype(np.int64), first)), pa.array([int(n_all)] * len(c.ids), pa.int64()),
                pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p), first)),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return group(stage).cogroup(group(answers)).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score_texts(documents(spark, sf_dir))
