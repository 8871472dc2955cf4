"""Packing documents into training sequences of several lengths.

Method: a document longer than the longest window gives whole windows and a tail.
Pieces are routed to tiers by length (a tier holds pieces over half its size and up
to it). The longest tier is packed first and the gaps of its windows are filled from
the shorter tiers, longest fitting piece first; in the shorter tiers, pieces that
fill a window of the tier exactly stand there, since a window at a power of two
needs no padding; what is left fills long windows. Sequences of one tier form step
groups of the same number of tokens.

Scale: which pieces share a window depends on lengths only, so the plan is made from
the histogram of piece lengths, which has at most ``window`` rows whatever the input,
and says which ranks of a length go to which windows. Pieces are ranked within their
length by task (counted while they are cut) and by the totals of the tasks before;
copies of one document, a hot length, are counted, never gathered. No text or id is
shuffled.

Cases: a null text is empty and gives one piece, the end id; repeated rows are
packed each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stage import materialize
from .common import documents, with_text
from .tokens import WORD_FILE, encoder, text_groups

WINDOW = 4096
TIERS = (512, 1024, 2048, 4096)
END_ID = 2
STEP_TOKENS = 64 * 4096

_PIECES = "part int, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, k long"


@dataclass
class Plan:
    """For each length, the ranks from ``lo`` on go ``times`` to a sequence, from ``sequence`` and ``offset`` on."""

    slots: dict[int, list[tuple[int, int, int, int]]]  # length -> [(lo, times, sequence, offset)]
    starts: list[int]  # first sequence of each run of equal sequences
    totals: list[int]  # tokens of a sequence of the run
    sequences: int


def plan_windows(counts: dict[int, int], window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> Plan:
    """Choose what shares a window from how many pieces there are of each length."""
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left)
    used = dict.fromkeys(left, 0)
    plan = Plan({n: [] for n in left}, [], [], 0)

    def place(pattern: list[tuple[int, int]], copies: int) -> None:
        offset = 0
        for n, times in pattern:
            plan.slots[n].append((used[n], times, plan.sequences, offset))
            used[n] += times * copies
            left[n] -= times * copies
            offset += n * times
            if not left[n]:
                lengths.pop(bisect_right(lengths, n) - 1)
        plan.starts.append(plan.sequences)
        plan.totals.append(offset)
        plan.sequences += copies

    def filled(first: int) -> list[tuple[int, int]]:
        """The piece and, again and again, the longest piece that still fits."""
        pattern, gap, taken = [(first, 1)], window - first, {first: 1}
        at = bisect_right(lengths, gap) - 1
        while gap and at >= 0:
            n = lengths[at]
            times = min(gap // n, left[n] - taken.get(n, 0))
            if times > 0:
                taken[n] = taken.get(n, 0) + times
                pattern.append((n, times))
                gap -= n * times
            at = min(at - 1, bisect_right(lengths, gap) - 1)
        merged: dict[int, int] = {}
        for n, times in pattern:
            merged[n] = merged.get(n, 0) + times
        return list(merged.items())

    def pack_down_to(least: int) -> None:
        while lengths and lengths[-1] >= least:
            pattern = filled(lengths[-1])
            place(pattern, min(left[n] // times for n, times in pattern))

    pack_down_to(window // 2 + 1)
    for tier in sorted((t for t in tiers if t < window), reverse=True):
        if left.get(tier):
            place([(tier, 1)], left[tier])
        for n in [n for n in lengths if n > tier // 2]:
            other = tier - n
            if other > 0 and left.get(n) and left.get(other):
                place([(n, 1), (other, 1)], min(left[n], left[other]))
        if left.get(tier // 2, 0) > 1:
            place([(tier // 2, 2)], left[tier // 2] // 2)
    pack_down_to(1)
    return plan


def step_groups(plan: Plan, window: int, tiers: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of sequences: its first sequence, its tier, the sequences of the tier before it, the tier's first step.

    A step takes the same number of sequences of one tier, and so the same number of tokens.
    """
    starts, totals = np.array(plan.starts, np.int64), np.array(plan.totals, np.int64)
    tier = np.where(np.isin(totals, tiers), totals, window)
    size = np.diff(np.append(starts, plan.sequences))
    before, first, step = np.zeros_like(starts), np.zeros_like(starts), 0
    for t in sorted(set(tier.tolist())):
        at = tier == t
        before[at] = np.cumsum(size[at]) - size[at]
        first[at] = step
        step += -(-int(size[at].sum()) // max(STEP_TOKENS // t, 1))
    return starts, tier, before, first


def cut(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """One row per piece with its place in its document, its checksum and its rank among the task's pieces of that length."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ranks = encoder(tokenizer), {}
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, parts, at = batch["doc_id"].to_pylist(), batch["part"].to_pylist(), 0
            for group in text_groups(batch["text"].to_pylist()):
                out = []
                for raw in enc.encode(group):
                    raw += end
                    n = len(raw) // 4
                    for start in range(0, n, window):
                        piece = raw[4 * start : 4 * (start + window)]
                        length = len(piece) // 4
                        k = ranks.get(length, 0)
                        ranks[length] = k + 1
                        out.append((parts[at], ids[at], start, length, zlib.crc32(piece), n, k))
                    at += 1
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                names = [c.split()[0] for c in _PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return docs.withColumn("part", F.spark_partition_id()).select("part", "doc_id", "text").mapInArrow(pieces, _PIECES)


def pack(
    docs: DataFrame, tokenizer: str = WORD_FILE, end_id: int = END_ID, window: int = WINDOW, tiers: tuple[int, ...] = TIERS
) -> DataFrame:
    """One row per piece: where it comes from, its sequence and offset there, the sequence's tier and its step group."""
    pieces = materialize(cut(with_text(docs), tokenizer, end_id, window), "pieces")
    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = by_task.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    plan = plan_windows(counts, window, tiers)
    table = {n: tuple(np.array(c, np.int64) for c in zip(*slots)) for n, slots in plan.slots.items()}
    starts, tier_of, run_at, first_step = step_groups(plan, window, tiers)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch["length"].to_numpy()
            rank = batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = length == n
                lo, times, first, begin = table[int(n)]
                s = np.searchsorted(lo, rank[at], "right") - 1
                inside = rank[at] - lo[s]
                sequence[at] = first[s] + inside // times[s]
                offset[at] = begin[s] + inside % times[s] * n
            run = np.searchsorted(starts, sequence, "right") - 1
            tier = tier_of[run]
            step = first_step[run] + (run_at[run] + sequence - starts[run]) // np.maximum(STEP_TOKENS // tier, 1)
            cols = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in cols] + [pa.array(x) for x in (sequence, offset, tier, step)],
                [*cols, "sequence_id", "offset", "tier", "step_id"],
            )

    ranked = pieces.join(base, ["length", "part"]).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("base") + F.col("k")).alias("rank"),
    )
    return ranked.mapInArrow(
        placed,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, tier long, step_id long",
    )


def op7_multi_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of up to 4096 tokens."""
    return pack(documents(spark, sf_dir))
