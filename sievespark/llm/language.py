"""Language identification in two steps: the family, then linear SVMs inside it.

Method: hashed byte trigrams of the letters, square-rooted and scaled to length 1.
Languages whose mean vectors are most alike form families (average-link clustering,
about the square root of the number of languages). A one-versus-rest linear SVM
picks the family; one-versus-one SVMs vote among the family's languages. A
temperature fitted on a held-out fifth turns margins into a score.

Scale: fitting uses about ``PER_LANG`` texts of each language, taken by a hash of
the id, a bound that doesn't follow the input; their features, not their texts, go
to the driver. Prediction is one pass over the whole texts without a shuffle, with
the same code and model for every row.

Cases: ``und`` with score 0 if a text is null or has no letter, or if nothing was
learned; one learned language is predicted everywhere with score 1; repeated rows
each get a row; ``lang`` is read for learning only; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder

WIDTH = 4096
PER_LANG = 800
UNDETERMINED = "und"
HELD_OUT = (4, 2)

_LETTER = re.compile(r"[^\W\d_]")
# ASCII characters that are no letters become a space; bytes of other characters stay.
_FOLD = bytes(
    c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def features(text: str) -> np.ndarray:
    """Length-1 vector of hashed byte trigrams of the whole text."""
    b = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    code = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    counts = np.bincount(code >> np.uint32(32 - 12), minlength=WIDTH).astype(np.float32)
    counts = np.sqrt(counts)
    return counts / max(float(np.linalg.norm(counts)), 1e-9)


@dataclass
class Model:
    langs: list[str]
    families: list[list[int]]
    family_w: np.ndarray  # families x (WIDTH + 1)
    pairs: list[tuple[int, int]]  # first against second, both in one family
    pair_w: np.ndarray
    sharpness: float = 4.0

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and scores of the rows of ``x``."""
        x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margins = x1 @ self.family_w.T
        family = margins.argmax(1)
        e = np.exp(self.sharpness * (margins - margins.max(1, keepdims=True)))
        p_family = (e / e.sum(1, keepdims=True))[np.arange(len(x)), family]
        won = np.zeros((len(x), len(self.langs)))
        if self.pairs:
            p = 1 / (1 + np.exp(-self.sharpness * np.clip(x1 @ self.pair_w.T, -50, 50)))
            for k, (a, b) in enumerate(self.pairs):
                won[:, a] += p[:, k]
                won[:, b] += 1 - p[:, k]
        lang, score = np.zeros(len(x), int), np.zeros(len(x))
        for f, members in enumerate(self.families):
            at = family == f
            inside = won[np.ix_(at, members)]
            best = inside.argmax(1)
            lang[at] = np.array(members)[best]
            share = inside[np.arange(len(best)), best] / max(len(members) - 1, 1) if len(members) > 1 else 1.0
            score[at] = p_family[at] * share
        return lang, np.clip(score, 0, 1)


def svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, epochs: int = 30, reg: float = 1e-4, seed: int = 7) -> np.ndarray:
    """A linear SVM by averaged mini-batch subgradient steps over the given rows of ``x``; the last weight is the bias.

    Only a batch of rows is copied at a time.
    """
    cost = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9)).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    mean, seen, rng = np.zeros_like(w), 0, np.random.default_rng(seed)
    for epoch in range(epochs):
        rate = 2.0 / (1 + 0.3 * epoch)
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), 64):
            at = order[i : i + 64]
            x1 = np.ones((len(at), len(w)), np.float32)
            x1[:, :-1] = x[rows[at]]
            wrong = np.where(y[at] * (x1 @ w) < 1, y[at] * cost[at], 0).astype(np.float32)
            w += rate * (wrong @ x1 / len(at) - reg * w)
            if epoch >= epochs // 2:
                seen += 1
                mean += (w - mean) / seen
    return mean


def cluster(centres: np.ndarray, families: int) -> list[list[int]]:
    """Average-link clusters of the unit vectors by cosine."""
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    sim = unit @ unit.T
    groups = [[i] for i in range(len(centres))]
    while len(groups) > families:
        best = max(
            ((sim[np.ix_(a, b)].mean(), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        )
        i, j = -best[1], -best[2]
        groups[i] = sorted(groups[i] + groups.pop(j))
    return sorted(groups)


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """Learn from feature rows and their languages."""
    langs = sorted(set(labels))
    number = {v: i for i, v in enumerate(langs)}
    y = np.array([number[v] for v in labels])
    families = cluster(np.stack([x[y == i].mean(0) for i in range(len(langs))]), int(np.ceil(np.sqrt(len(langs)))))
    of = {i: f for f, members in enumerate(families) for i in members}
    pairs = [(a, b) for members in families for k, a in enumerate(members) for b in members[k + 1 :]]
    held = np.arange(len(y)) % 5 == 4

    def learn(rows: np.ndarray) -> Model:
        rows = np.flatnonzero(rows)
        fy = y[rows]
        fam = np.array([of[i] for i in fy])
        family_w = np.stack([svm(x, rows, np.where(fam == f, 1, -1)) for f in range(len(families))])
        pair_w = [svm(x, rows[at], np.where(fy[at] == a, 1, -1)) for a, b in pairs for at in [(fy == a) | (fy == b)]]
        return Model(langs, families, family_w, pairs, np.stack(pair_w) if pairs else np.zeros((0, x.shape[1] + 1), np.float32))

    if len(langs) > 1 and len(y) >= 50 * len(langs):
        trial, loss = learn(~held), {}
        for s in (1.0, 2.0, 4.0, 8.0, 16.0):
            trial.sharpness = s
            lang, score = trial.predict(x[held])
            p = np.where(lang == y[held], score, (1 - score) / (len(langs) - 1))
            loss[s] = -np.log(np.maximum(p, 1e-6)).mean()
        model = learn(np.ones(len(y), bool))
        model.sharpness = min(loss, key=loss.get)
        return model
    return learn(np.ones(len(y), bool))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(v, features(t)) for t, v in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()) if has_letter(t)]
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array([v for v, _ in rows], pa.string()), "x": pa.array([x.astype(np.float16).tobytes() for _, x in rows], pa.binary())}
        )


def learn_languages(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Fit on about ``per_lang`` labelled training texts of each language; None if there are none."""
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(
        F.col("lang").isNotNull() & (id_remainder(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1])
    )
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not sizes:
        return None
    kept = F.lit(False)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("languages")), F.lit(1 << 30)) / float(1 << 30)
    for lang, n in sizes.items():
        kept = kept | ((F.col("lang") == lang) & (draw < min(1.0, per_lang / n)))
    rows = train.where(kept).select("text", "lang").mapInArrow(_feature_rows, "lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (bytes(r["x"]), r["lang"]))
    order = np.random.default_rng(1).permutation(len(rows))
    x = np.empty((len(rows), WIDTH), np.float32)
    for k, i in enumerate(order):
        x[k] = np.frombuffer(rows[i]["x"], np.float16)
    labels = [rows[i]["lang"] for i in order]
    del rows
    return fit(x, labels)


def identify(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """``lang_pred`` and ``score`` of every row's whole text, beside the columns ``keep``."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"]
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if model is not None:
                for i in range(0, len(texts), 256):
                    part = [(i + k, t) for k, t in enumerate(texts[i : i + 256].to_pylist()) if has_letter(t)]
                    if part:
                        got, p = model.predict(np.stack([features(t) for _, t in part]))
                        for (k, _), g, s in zip(part, got, p):
                            lang[k], score[k] = model.langs[g], s
            out = {c: batch[c] for c in keep} | {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score)}
            yield pa.RecordBatch.from_pydict(out)

    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["lang_pred string", "score double"])
    return docs.select("text", *[c for c in keep if c != "text"]).mapInArrow(predict, schema)


def op8_family_then_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn_languages(docs), "doc_id")
    held = id_remainder(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
