"""SimHash near duplicates through pivot distance tables.

Method: every distinct fingerprint gets a table of Hamming distances to reference
fingerprints (pivots). By the triangle inequality two fingerprints at distance d
differ by at most d in every coordinate, so pairs whose largest coordinate
difference exceeds the radius are discarded, and the survivors are verified.

Two kinds of pivots are used. ``SCATTERED`` ones are random and filter pairs. The
others come in blocks: an origin, and the origin with one bit flipped, for each bit
of a block. Their coordinates, relative to the origin's, spell the block's bits, so
this part of the table is kept as the bits themselves. Six blocks hold 64 bits; three
differing bits leave at least three blocks untouched, where the coordinates agree
exactly. Grouping by the coordinates of each 3 of 6 blocks (20 groupings) therefore
loses no link, and groups stay near one random fingerprint per 2**32.

Scale: copies collapse to one fingerprint first. A group is compared within a task; a
group over ``HOT`` fingerprints is dealt into parts, and every two parts meet in a task
of their own. A task emits links that connect what it found, not all pairs.
Components are found by distributed union of stars.

Cases: a null or empty text has no words and fingerprint zero, linked like any other;
repeated rows each get a row; a null id is never the smallest id of a component unless
all are null; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import materialize
from .common import documents, with_text
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
SCATTERED = 16
HOT = 2048
GROUP_ROWS = 100_000

_PIVOTS = np.random.default_rng(2024).integers(0, 1 << 63, SCATTERED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a text's 3-word shingles, as an unsigned number."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    n = max(len(words) - SHINGLE + 1, 1)
    after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # where the next word starts
    starts = [0, *after[: n - 1].tolist()]
    ends = (after[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(data[s:e], SEED) for s, e in zip(starts, ends)], np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = hashes[i : i + 65536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to the scattered pivots, a row of bytes each."""
    return np.bitwise_count(prints[:, None] ^ _PIVOTS[None, :])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``check`` (a hash of the text) and ``fp`` (the fingerprint's bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["check"], pa.array(fps.view(np.int64))], ["doc_id", "check", "fp"])

    return with_text(docs).withColumn("check", F.xxhash64("text")).mapInArrow(run, "doc_id long, check long, fp long")


def block_masks() -> list[int]:
    """For each 3 of the 6 blocks, the bits they hold, as a signed long."""
    blocks, at = [], 0
    for width in BLOCK_BITS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    keep = len(blocks) - RADIUS
    masks = [sum(c) for c in combinations(blocks, keep)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _links_of_run(prints: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the linked fingerprints of one group: each with the first of its component."""
    n = len(prints)
    near = np.zeros((n, n), bool)
    for i in range(0, n, 64):
        apart = np.zeros((min(64, n - i), n), np.uint8)
        for k in range(table.shape[1]):
            np.maximum(apart, np.abs(table[i : i + 64, None, k].astype(np.int8) - table[None, :, k].astype(np.int8)).astype(np.uint8), out=apart)
        a, b = np.nonzero(apart <= RADIUS)
        good = np.bitwise_count(prints[i + a] ^ prints[b]) <= RADIUS
        near[i + a[good], b[good]] = True
    label = np.arange(n)
    while True:
        least = np.where(near, label[None, :], n).min(1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    at = np.flatnonzero(label != np.arange(n))
    return prints[at], prints[label[at]]


def _links(table: pa.Table) -> pa.Table:
    """Links among the fingerprints that share a run key."""
    run, fp = table["run"].to_numpy(), table["fp"].to_numpy()
    order = np.lexsort((fp, run))
    run, prints = run[order], fp[order].view(np.uint64)
    coordinates = pivot_table(prints)
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.array([], int)
    size = np.diff(np.append(first, len(run)))
    a, b = [], []
    small = np.repeat(size, size) <= 16
    for d in range(1, 16):
        i = np.flatnonzero(small[:-d] & (run[d:] == run[:-d])) if len(run) > d else np.array([], int)
        if not len(i):
            break
        apart = np.abs(coordinates[i].astype(np.int8) - coordinates[i + d].astype(np.int8)).max(1)
        i = i[apart <= RADIUS]
        i = i[np.bitwise_count(prints[i] ^ prints[i + d]) <= RADIUS]
        a.append(prints[i])
        b.append(prints[i + d])
    for s, n in zip(first[size > 16], size[size > 16]):
        x, y = _links_of_run(prints[s : s + n], coordinates[s : s + n])
        a.append(x)
        b.append(y)
    pairs = np.stack([np.concatenate(a), np.concatenate(b)], 1) if a else np.zeros((0, 2), np.uint64)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0).view(np.int64)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def links(distinct: DataFrame, hot: int = HOT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pairs (a, b) whose components are those of all pairs of ``fp`` within the radius."""
    masks = block_masks()
    keyed = distinct.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "block")
    ).select("fp", F.xxhash64("t", "block").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / (hot // 2)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts.cast("long")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda x: F.xxhash64(F.col("key"), F.least(x, mine), F.greatest(x, mine)),
    )
    members = keyed.join(shared, "key").select(
        "fp", F.explode(F.when(F.col("n") <= hot, F.array(F.col("key"))).otherwise(meets)).alias("run")
    )
    groups = max(1, -(-distinct.count() * 4 // group_rows))
    return members.groupBy(F.pmod("run", F.lit(groups)).alias("g")).applyInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``check``, ``fp``, ``label`` (a number of the component) and ``component_id`` of every row."""
    prints = materialize(fingerprints(docs), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    labels = components(links(distinct))
    marked = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("label", "fp").alias("label")
    )
    smallest = marked.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_print = materialize(marked.join(smallest, "label").select("fp", "label", "component_id"), "simhash-labels")
    return prints.join(of_print, "fp")


def keep_first_documents(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the smallest id (nulls last), then the smallest hash of the text."""
    last = F.lit((1 << 63) - 1)
    own = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), last)).withColumn(
        "_check", F.xxhash64(F.coalesce("text", F.lit("")))
    )
    first = near_duplicates(docs).groupBy("label").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("_doc"), F.col("check").alias("_check"))).alias("k"))
    return own.join(first.select("k.*"), ["_doc", "_check"], "left_semi").dropDuplicates(["_doc", "_check"]).drop("_doc", "_check")


def op3_pivot_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
