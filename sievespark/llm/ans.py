"""Token ids in files coded by a static range asymmetric numeral system.

Method: documents are put in ascending order of their id, tokenised, and cut into
segments of whole documents. A segment has one frequency table, shared by its blocks.
A block codes ``BLOCK`` ids on ``LANES`` interleaved states and stands alone: its
header holds the decoder's states and the place of its words (a checkpoint) and a
checksum of its ids, so blocks decode in parallel and in any order.

File format: a folder of Parquet files, a row per segment. ``part`` and ``segment``
give the order, ``doc_ids`` and ``doc_tokens`` the documents, ``payload`` is

    magic ``RANS``, version, probability bits, lanes, block size, symbols, ids (u32 each),
    length of the table (u32), the table (deflated: id differences, then frequencies, u32),
    per block: ids, words, crc32 of its ids (u32 each), then the states (u64 x lanes),
    all blocks' words (u32), and the crc32 of everything before (u32).

Scale: one shuffle, of texts, by ranges of the id. Blocks are coded side by side with
numpy. A segment closes after ``SEGMENT`` ids, which bounds a task's memory by that and
the longest document. The ids before a part come from a table with a row per part.
Spark's writer commits the files, so lost executors leave no partial ones.

Cases: a null text is empty and holds the end id only; equal ids (repeated rows, null
ids) keep any order among themselves; an empty table gives no rows; extra columns are
not read. A damaged payload raises an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stage import new_path
from .common import documents, with_text
from .tokens import BYTE_FILE, encoder, text_groups

END_ID = 0
SEGMENT = 4_000_000
BLOCK = 16_384
LANES = 32
BITS = 20
_LOW = np.uint64(1 << 31)
_HEADER = struct.Struct("<4s7I")
_FILE = "part int, segment int, n_ids long, doc_ids array<long>, doc_tokens array<long>, payload binary"


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and their frequencies, at least 1 each, scaled to sum to ``2**BITS``."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    total = 1 << BITS
    if len(symbols) > total // 2:
        raise ValueError("more distinct ids in a segment than the probability scale can hold")
    freq = np.maximum(counts * total // counts.sum(), 1)
    rest = total - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if rest > 0:
        freq[order[0]] += rest
    for i in order:
        if rest >= 0:
            break
        take = min(-rest, int(freq[i]) // 2)
        freq[i] -= take
        rest += take
    return symbols.astype(np.uint32), freq.astype(np.uint64)


def _shape(n: int) -> tuple[int, int]:
    """Blocks and steps of ``n`` ids."""
    return max(-(-n // BLOCK), 1), BLOCK // LANES


def encode(ids: np.ndarray) -> bytes:
    """The payload of a segment's ids (one id or more)."""
    symbols, freq = frequencies(ids)
    start = np.cumsum(freq) - freq
    blocks, steps = _shape(len(ids))
    padded = np.full(blocks * BLOCK, ids[0], np.uint32)
    padded[: len(ids)] = ids
    number = np.zeros(int(symbols[-1]) + 1, np.uint32)
    number[symbols] = np.arange(len(symbols), dtype=np.uint32)
    index = number[padded].reshape(blocks, steps, LANES)
    state = np.full((blocks, LANES), _LOW, np.uint64)
    words = np.zeros((blocks, steps, LANES), np.uint32)
    sent = np.zeros((blocks, steps, LANES), bool)
    bits, word = np.uint64(BITS), np.uint64(32)
    limit = np.uint64(63 - BITS)
    for t in range(steps - 1, -1, -1):
        f, c = freq[index[:, t]], start[index[:, t]]
        full = state >= (f << limit)
        words[:, t], sent[:, t] = state.astype(np.uint32), full
        state = np.where(full, state >> word, state)
        q = state // f
        state = (q << bits) + (state - q * f) + c
    table = zlib.compress(np.concatenate([np.diff(symbols, prepend=np.uint32(0)), freq.astype(np.uint32)]).astype("<u4").tobytes(), 6)
    raw = ids.astype("<u4").tobytes()
    parts = [_HEADER.pack(b"RANS", 1, BITS, LANES, BLOCK, len(symbols), len(ids), len(table)), table]
    lengths = sent.sum((1, 2))
    for b in range(blocks):
        own = raw[4 * b * BLOCK : 4 * (b + 1) * BLOCK]
        parts.append(struct.pack("<3I", len(own) // 4, int(lengths[b]), zlib.crc32(own)) + state[b].astype("<u8").tobytes())
    parts.append(words[sent].astype("<u4").tobytes())
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def decode(payload: bytes, only: list[int] | None = None) -> np.ndarray:
    """The ids of a payload, or of the blocks ``only``."""
    body = payload[:-4]
    if struct.unpack("<I", payload[-4:])[0] != zlib.crc32(body):
        raise ValueError("damaged segment: checksum differs")
    magic, version, bits_, lanes, block, n_symbols, n, n_table = _HEADER.unpack_from(body)
    if magic != b"RANS" or version != 1:
        raise ValueError("not a segment of this format")
    at = _HEADER.size
    table = np.frombuffer(zlib.decompress(body[at : at + n_table]), "<u4")
    symbols, freq = np.cumsum(table[:n_symbols], dtype=np.uint32), table[n_symbols:].astype(np.uint64)
    start = np.cumsum(freq) - freq
    at += n_table
    blocks = max(-(-n // block), 1)
    head = np.frombuffer(body, np.dtype([("n", "<u4"), ("words", "<u4"), ("crc", "<u4"), ("state", "<u8", (lanes,))]), blocks, at)
    words = np.frombuffer(body, "<u4", offset=at + head.nbytes).astype(np.uint64)
    words = np.append(words, np.uint64(0))
    chosen = np.arange(blocks) if only is None else np.array(only)
    read = (np.cumsum(head["words"].astype(np.int64)) - head["words"])[chosen]
    state = head["state"][chosen].astype(np.uint64)
    slot = np.repeat(np.arange(n_symbols, dtype=np.uint32), freq.astype(np.int64))
    mask, bits, word = np.uint64((1 << bits_) - 1), np.uint64(bits_), np.uint64(32)
    out = np.zeros((len(chosen), block // lanes, lanes), np.uint32)
    for t in range(block // lanes):
        low = state & mask
        s = slot[low]
        out[:, t] = s
        state = freq[s] * (state >> bits) + low - start[s]
        short = state < _LOW
        place = read[:, None] + np.cumsum(short, 1) - 1
        state = np.where(short, (state << word) | words[np.where(short, place, -1)], state)
        read = read + short.sum(1)
    found = []
    for b, ids in zip(chosen, symbols[out.reshape(len(chosen), -1)]):
        own = ids[: head["n"][b]]
        if zlib.crc32(own.astype("<u4").tobytes()) != head["crc"][b]:
            raise ValueError(f"damaged block {b}: checksum differs")
        found.append(own)
    return np.concatenate(found)


def write_ids(docs: DataFrame, path: str, tokenizer: str = BYTE_FILE, end_id: int = END_ID, segment: int = SEGMENT) -> None:
    """Write the ids of all documents, each with ``end_id`` after it, in ascending order of ``doc_id``."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        ids: list = []
        raws: list[bytes] = []
        held, part, number = 0, 0, 0

        def closed() -> pa.RecordBatch:
            n = [len(r) // 4 for r in raws]
            row = [part, number, sum(n), ids, n, encode(np.frombuffer(b"".join(raws), "<u4"))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], [c.split()[0] for c in _FILE.split(", ")])

        for batch in batches:
            own, at = batch["doc_id"].to_pylist(), 0
            for group in text_groups(batch["text"].to_pylist()):
                for raw in enc.encode(group):
                    part = batch["part"][at].as_py()
                    ids.append(own[at])
                    raws.append(raw + end)
                    held += len(raw) // 4 + 1
                    at += 1
                    if held >= segment:
                        yield closed()
                        ids, raws, held, number = [], [], 0, number + 1
        if raws:
            yield closed()

    ordered = with_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered = ordered.withColumn("part", F.spark_partition_id())
    ordered.select("part", "doc_id", "text").mapInArrow(segments, _FILE).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """The documents read back, and the ids before each segment.

    A document has ``part``, ``segment``, ``doc_id``, ``inside`` (ids before it in the
    segment), ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids`` (little-endian u32).
    """
    files = spark.read.schema(_FILE).parquet(path)
    per = files.groupBy("part", "segment").agg(F.sum("n_ids").alias("n"))
    parts = per.groupBy("part").agg(F.sum("n").alias("n"))
    before_part = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    base = per.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(
        parts.select("part", before_part.alias("before")), "part"
    )
    starts = base.select("part", "segment", (F.col("before") + F.col("inside")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"]
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode(batch["payload"][i].as_py())
                n = np.array(batch["doc_tokens"][i].as_py(), np.int64)
                if n.sum() != len(ids):
                    raise ValueError("damaged segment: document lengths differ")
                ends, raw = np.cumsum(n), ids.astype("<u4").tobytes()
                own = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch["part"][i].as_py()] * len(n), pa.int32()),
                        pa.array([batch["segment"][i].as_py()] * len(n), pa.int32()),
                        batch["doc_ids"][i].values,
                        pa.array(ends - n),
                        pa.array(n),
                        pa.array([zlib.crc32(r) for r in own], pa.int64()),
                        pa.array(own if with_ids else [None] * len(own), pa.binary()),
                    ],
                    names,
                )

    rows = files.select("part", "segment", "doc_ids", "doc_tokens", "payload").mapInArrow(
        read, "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long, ids binary"
    )
    return rows, starts


def documents_read(spark: SparkSession, path: str) -> DataFrame:
    """Digest of each document in the files."""
    rows, starts = read_ids(spark, path, with_ids=False)
    return rows.drop("ids").join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def op10_interleaved_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenised, written, and read back."""
    path = new_path(spark, "rans")
    write_ids(documents(spark, sf_dir), path)
    return documents_read(spark, path)
