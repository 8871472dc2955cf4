"""Mixing sources to target weights by multinomial draws of fixed-length blocks.

Method: the words of a source, in the order of its documents, are packed into blocks of
``BLOCK`` words (the last is shorter). The output is dealt in shards of ``SHARD`` slots,
a block each. For every shard the counts of its sources are drawn from a multinomial
distribution whose weights are the slots that the sources are due in all; its slots are then the next indices of
their sources. An index is mapped to a block by a pseudorandom permutation of the
source's block numbers, another one for each pass over the source, and slots and blocks
are joined by source and block.

Targets are met to the word: the draws of a source miss what it is due by about a root,
so the slots drawn beyond it are given to the sources that are short of slots, one by
one, and the last block of a source is cut. No block is taken twice in a pass, and there are
two passes at most, so a document gives each word twice at most.

The draw of a slot is a hash of shard and slot, the permutation a Feistel network over
the block numbers, so reruns, lost executors and other partitionings give the same mix.

Scale: no source is a key by itself. Offsets in a source come from running totals over
range partitions; draws find their source by an equi-join on ranges of weight, of which
there are two per source at most; blocks join on (source, block). A text is shuffled to its
pieces once and only if texts are asked for. The tables of sources and shards are
never collected.

Cases: a null text has no words; such documents keep their row and take nothing. A null
source is a source of its own, the last. Repeated rows are documents of their own.
Null ids are kept (they come first in a source). An empty table, or one without words,
gives an empty mix. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType

from ..operators.windows import dense_index, running_totals
from ..sources.stage import materialize
from .common import documents, with_text, words_of

WEIGHTS = (5, 2, 1)
#: Words taken in all, as a share of all words, and from a source at most.
SHARE, PASSES = 1.5, 2
BLOCK, SHARD = 512, 512
SEED = 253


# Block numbers ------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, half: np.ndarray, key: np.ndarray, back: bool) -> np.ndarray:
    """Four Feistel rounds on numbers of two halves of ``half`` bits."""
    low = (np.uint64(1) << half) - np.uint64(1)
    a, b = x >> half, x & low
    for k in (3, 2, 1, 0) if back else (0, 1, 2, 3):
        turn = np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        if back:
            a, b = b ^ (_mixed(a ^ key ^ turn) & low), a
        else:
            a, b = b, a ^ (_mixed(b ^ key ^ turn) & low)
    return a << half | b


def permuted(index: np.ndarray, size: np.ndarray, source: np.ndarray, turn: np.ndarray, back: bool = False, seed: int = SEED) -> np.ndarray:
    """A permutation of 0 .. size - 1 for each source and turn, applied to each index (or undone).

    The network permutes the next larger even power of two; results beyond ``size``
    go through it again until they are within, which keeps it a permutation.
    """
    with np.errstate(over="ignore"):
        x, size = index.astype(np.uint64), size.astype(np.uint64)
        key = _mixed(source.astype(np.uint64) * np.uint64(4) + turn.astype(np.uint64) + np.uint64(seed << 32))
        half = np.maximum(np.ceil(np.log2(np.maximum(size, 2).astype(np.float64)) / 2), 1).astype(np.uint64)
        out = _network(x, half, key, back)
        left = np.nonzero(out >= size)[0]
        while len(left):
            out[left] = _network(out[left], half[left], key[left], back)
            left = left[out[left] >= size[left]]
    return out.astype(np.int64)


@F.pandas_udf(LongType())
def block_at(index: pd.Series, size: pd.Series, source: pd.Series, turn: pd.Series) -> pd.Series:
    """The block at a place of a pass over a source."""
    return pd.Series(permuted(*(c.to_numpy(np.int64) for c in (index, size, source, turn))))


@F.pandas_udf(LongType())
def place_of(block: pd.Series, size: pd.Series, source: pd.Series, turn: pd.Series) -> pd.Series:
    """The place of a block in a pass over a source."""
    return pd.Series(permuted(*(c.to_numpy(np.int64) for c in (block, size, source, turn)), back=True))


# Sources ------------------------------------------------------------------------------------


def sized(docs: DataFrame) -> DataFrame:
    """A row per document: ``src`` (its source), ``size`` in words, ``sum`` (a hash of the text)."""
    plain = with_text(docs, F.col("source").cast("string").alias("src"))
    return plain.select("doc_id", "src", F.size(words_of(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("sum"))


def source_targets(sizes: DataFrame, share: float = SHARE) -> DataFrame:
    """Per source: its number ``s``, name, size, and the words it should give.

    Sources share by weight what those at their limit leave. A source is at its limit if
    the level at which it gets there is reached before the total is: sources are taken in
    the order of that level, with the running totals of limits and weights.
    """
    found = materialize(sizes.groupBy("src").agg(F.sum("size").alias("source_size")), "sources")
    found = dense_index(found, [F.col("src").asc_nulls_last()], "s").withColumn(
        "weight", F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("s") % len(WEIGHTS)).cast("int")).cast("long"))
    found = found.withColumn("limit", PASSES * F.col("source_size")).withColumn("level", F.col("limit") / F.col("weight"))
    summed = running_totals(found, [], ["level", "s"], {"limit": "limits", "weight": "weights"})
    summed = materialize(summed, "source-levels")
    words, weights = summed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).head()
    total = share * words
    at = summed.withColumn("full", F.col("limits") + F.col("level") * (F.lit(weights) - F.col("weights")) <= F.lit(total))
    held, free = at.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))), F.lit(0)), F.sum(F.when(~F.col("full"), F.col("weight")))).head()
    share_of = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(
        F.least(F.lit(float(total - held)) * F.col("weight") / F.lit(float(free or 1)), F.col("limit").cast("double")))
    return at.select("s", "src", "source_size", share_of.alias("target"))


def slots_due(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add per source: ``blocks`` it has, ``due`` slots, and ``cut``, the words to cut from the last of them."""
    size, quota = F.col("source_size"), F.least(F.floor(F.col("target") + 0.5), PASSES * F.col("source_size"))
    at = targets.withColumn("quota", quota).withColumn("blocks", F.ceil(size / block).cast("long"))
    at = at.withColumn("passes", F.when(size > 0, F.floor(F.col("quota") / size)).otherwise(0).cast("long"))
    at = at.withColumn("rest", F.col("quota") - F.col("passes") * size)
    # The words missing in the short block, and where the pass that isn't whole has it.
    at = at.withColumn("short", F.col("blocks") * block - size).withColumn(
        "at", F.when(F.col("blocks") > 0, place_of(F.greatest(F.col("blocks") - 1, F.lit(0)), F.greatest("blocks", F.lit(1)), "s", "passes")))
    plain = F.ceil(F.col("rest") / block)
    needed = F.when(F.col("at") < plain, F.ceil((F.col("rest") + F.col("short")) / block)).otherwise(plain)
    given = needed * block - F.when(F.col("at") < needed, F.col("short")).otherwise(0)
    return at.select(
        "s", "src", "source_size", "target", "blocks", (F.col("passes") * F.col("blocks") + needed).cast("long").alias("due"),
        (given - F.col("rest")).cast("long").alias("cut"))


# Slots --------------------------------------------------------------------------------------


def draw_slots(sources: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """A row per slot of the output: ``shard``, ``slot``, the source ``s`` and its ``index``, from 0 to what the source is due."""
    spark = sources.sparkSession
    due = sources.where("due > 0").select("s", "due")
    ranges = materialize(running_totals(due, [], ["s"], {"due": "upto"}).withColumn("low", F.col("upto") - F.col("due")), "due")
    total, n = ranges.agg(F.coalesce(F.max("upto"), F.lit(0)), F.count(F.lit(1))).head()
    width = max(1, total // max(1, n))
    # Every draw is a number below the total; the source that holds it is found by parts of equal width.
    parts = ranges.select("s", "low", "upto", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("upto") - 1) / width))).alias("part"))
    slots = spark.range(total).select(F.floor(F.col("id") / shard).alias("shard"), (F.col("id") % shard).alias("slot"))
    slots = slots.withColumn("_d", F.pmod(F.xxhash64(F.lit(seed), "shard", "slot"), F.lit(max(1, total))))
    drawn = slots.withColumn("part", F.floor(F.col("_d") / width)).join(parts, "part").where("_d >= low and _d < upto")
    drawn = materialize(drawn.select("shard", "slot", "s"), "drawn")
    # The multinomial counts, and where each shard's begin in its source.
    counts = running_totals(drawn.groupBy("shard", "s").agg(F.count(F.lit(1)).alias("n")), ["s"], ["shard"], {"n": "upto"})
    counts = materialize(counts, "shard-counts")
    within = F.row_number().over(W.partitionBy("shard", "s").orderBy("slot"))  # a shard's slots at most
    placed = drawn.withColumn("_r", within).join(counts, ["shard", "s"]).select(
        "shard", "slot", "s", (F.col("upto") - F.col("n") + F.col("_r") - 1).alias("index"))
    # Slots beyond what their source is due go, in order, to the sources that have fewer.
    got = counts.groupBy("s").agg(F.max("upto").alias("got"))
    missed = ranges.select("s", "due").join(got, "s", "left").select("s", "due", F.coalesce("got", F.lit(0)).alias("got"))
    missed = missed.select("s", "due", "got", F.greatest(F.col("got") - F.col("due"), F.lit(0)).alias("over"), F.greatest(F.col("due") - F.col("got"), F.lit(0)).alias("under"))
    missed = materialize(running_totals(missed, [], ["s"], {"over": "overs", "under": "unders"}), "missed")
    lacking = missed.where("under > 0").select(
        F.col("s").alias("to"), (F.col("unders") - F.col("under")).alias("first"), "got", F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1)).alias("k")
    ).select((F.col("first") + F.col("k")).alias("free"), "to", (F.col("got") + F.col("k")).alias("to_index"))
    placed = placed.join(missed.select("s", "due", (F.col("overs") - F.col("over")).alias("first")), "s")
    beyond = F.col("index") >= F.col("due")
    placed = placed.withColumn("free", F.when(beyond, F.col("first") + F.col("index") - F.col("due")))
    return placed.join(lacking, "free", "left").select(
        "shard", "slot", F.coalesce("to", "s").alias("s"), F.coalesce("to_index", "index").alias("index"))


def slot_blocks(slots: DataFrame, sources: DataFrame) -> DataFrame:
    """Slots with their ``block``, and ``cut``, the words that the last slot of a source leaves out."""
    at = slots.join(sources.select("s", "blocks", "due", "cut"), "s")
    turn, place = F.floor(F.col("index") / F.col("blocks")), F.col("index") % F.col("blocks")
    return at.select(
        "shard", "slot", "s", block_at(place, F.col("blocks"), F.col("s"), turn).alias("block"),
        F.when(F.col("index") == F.col("due") - 1, F.col("cut")).otherwise(0).alias("cut"))


# Blocks -------------------------------------------------------------------------------------


def placed_documents(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with their source's number and ``offset``, the words of the source before them."""
    at = sizes.join(sources.select("s", "src").withColumnRenamed("src", "_src"), F.col("src").eqNullSafe(F.col("_src"))).drop("src", "_src")
    # Rows that tie are repeats of one document.
    order = [F.col("doc_id").asc_nulls_first(), "sum", "size"]
    return running_totals(at, ["s"], order, {"size": "upto"}).withColumn("offset", F.col("upto") - F.col("size")).drop("upto")


def packed_blocks(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The pieces of documents in blocks: ``start`` in the document, ``at`` in the block, ``length``, and the block's own length."""
    has = placed.where("size > 0")
    last = F.floor((F.col("offset") + F.col("size") - 1) / block)
    pieces = has.select("*", F.explode(F.sequence(F.floor(F.col("offset") / block), last)).alias("block"))
    low = F.greatest(F.col("block") * block, F.col("offset"))
    high = F.least((F.col("block") + 1) * block, F.col("offset") + F.col("size"))
    return pieces.select(
        "s", "block", "doc_id", "sum", "offset", (low - F.col("offset")).alias("start"), (low - F.col("block") * block).alias("at"), (high - low).alias("length"))


class Mix:
    """A planned mix: its sources, its documents, and what each slot takes of which document."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, shard: int = SHARD, share: float = SHARE, seed: int = SEED):
        self.docs = docs
        sizes = materialize(sized(docs), "sizes")
        self.sources = materialize(slots_due(source_targets(sizes, share), block), "sources")
        self.documents = materialize(placed_documents(sizes, self.sources), "placed")
        self.slots = slot_blocks(draw_slots(self.sources, shard, seed), self.sources)
        pieces = packed_blocks(self.documents, block)
        size = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
        taken = self.slots.join(pieces, ["s", "block"]).join(self.sources.select("s", "source_size"), "s")
        left = F.least("length", size - F.col("cut") - F.col("at"))
        #: Rows (shard, slot, at): ``length`` words of a document from ``start``.
        self.pieces = taken.select("shard", "slot", "s", "block", "at", "doc_id", "sum", "offset", "start", left.alias("length")).where("length > 0")

    def taken(self) -> DataFrame:
        """Every document with the words taken from it, repeats counted."""
        by = self.pieces.groupBy("s", "offset").agg(F.sum("length").alias("taken"))
        # Documents without words share the offset of the next one, but take nothing.
        key = F.when(F.col("size") > 0, F.col("offset"))
        rows = self.documents.withColumn("offset", key).join(by, ["s", "offset"], "left")
        return rows.join(self.sources.select("s", "source_size", "target"), "s").select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def blocks(self) -> DataFrame:
        """The output: a row per slot with its words, joined by one space.

        Pieces are gathered per document first, so that a text goes to one task once,
        and leave it as short texts; a slot holds a block's words at most.
        """
        cuts = self.pieces.groupBy("doc_id", "sum").agg(F.collect_list(F.struct("shard", "slot", "s", "at", "start", "length")).alias("cuts"))
        cuts = cuts.withColumnRenamed("doc_id", "_id")
        texts = with_text(self.docs).withColumn("sum", F.xxhash64("text")).dropDuplicates(["doc_id", "sum"])
        both = texts.join(cuts, (texts["sum"] == cuts["sum"]) & F.col("doc_id").eqNullSafe(F.col("_id")))
        split = both.select("cuts", words_of(F.col("text")).alias("words"))
        parts = split.select(F.explode(F.transform("cuts", lambda c: F.struct(
            c["shard"].alias("shard"), c["slot"].alias("slot"), c["s"].alias("s"), c["at"].alias("at"), c["length"].alias("length"),
            F.array_join(F.slice("words", (c["start"] + 1).cast("int"), c["length"].cast("int")), " ").alias("text")))).alias("p")).select("p.*")
        held = F.sort_array(F.collect_list(F.struct("at", "text")))
        return parts.groupBy("shard", "slot", "s").agg(F.sum("length").alias("n_words"), F.array_join(held["text"], " ").alias("text")).join(
            self.sources.select("s", F.col("src").alias("source")), "s").select("shard", "slot", "source", "n_words", "text")


def op11_multinomial_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its size, its source's size and target, and the words that the mix takes."""
    return Mix(documents(spark, sf_dir, "source")).taken()
