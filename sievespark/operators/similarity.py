"""Set similarity of fingerprints against a context, without writing pairs.

A query's feature is the mean of a coefficient over all context rows. Its parts
(shared bits, sizes) come from one matrix product per block of queries and block
of context rows, inside a task that returns one row of sums per query. A context
of checked small size is broadcast; a larger one is cut into blocks, and every
query meets each block once. Best matches hold a context of checked size in every task
too, with its MinHash order, so that queries pass it without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import fits_rows, materialize
from .neighbours import SLICE_ROWS, adjacent_in_order, blocks_for
from .textfeatures import FINGERPRINT_BITS

COEFFICIENTS = ("dice", "tanimoto", "tversky", "cosine", "sokal", "russel", "kulczynski", "mcconnaughey")
TVERSKY_WEIGHTS = (0.5, 0.5)  # fixed values
BLOCK_ROWS = 4_096  # with the default width a block is 32 MiB
BLOCK_BYTES = 64 << 20
LINEAR_BYTES = 64 << 20
HELD_BYTES = 64 << 20  # codes and sets of a context that every task may hold
_VALUES = 1 << 16
_BATCH = 256


def coefficients(a, b, c, n_bits: int, weights: tuple[float, float] = TVERSKY_WEIGHTS) -> dict[str, np.ndarray]:
    """Coefficients from set sizes and shared counts; 0 where undefined."""
    alpha, beta = weights

    def over(x, y):
        return np.divide(x, y, out=np.zeros(np.broadcast(x, y).shape), where=np.broadcast_to(y != 0, np.broadcast(x, y).shape))

    ab = a * b
    return {
        "dice": over(2 * c, a + b),
        "tanimoto": over(c, a + b - c),
        "tversky": over(c, alpha * (a - c) + beta * (b - c) + c),
        "cosine": over(c, np.sqrt(ab)),
        "sokal": over(c, 2 * a + 2 * b - 3 * c),
        "russel": c / n_bits,
        "kulczynski": over(c * (a + b), 2 * ab),
        "mcconnaughey": over(c * (a + b) - ab, ab),
    }


def _dense(bits: pd.Series, n_bits: int) -> np.ndarray:
    sets = [np.asarray(x if x is not None else [], dtype=np.int64) for x in bits]
    out = np.zeros((len(sets), n_bits), dtype=np.float32)
    if sets:
        out[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)] = 1
    return out


def _sums(ids, bits, context: np.ndarray, n_bits: int, names: Sequence[str], weights) -> pd.DataFrame:
    """Per query: coefficient sums over a block of context rows."""
    b = context.sum(axis=1, dtype=np.float64)
    parts = []
    for at in range(0, len(ids), _BATCH):
        q = _dense(bits[at : at + _BATCH], n_bits)
        shared = (q @ context.T).astype(np.float64)
        found = coefficients(q.sum(axis=1, dtype=np.float64)[:, None], b[None, :], shared, n_bits, weights)
        parts.append(pd.DataFrame({"id": ids[at : at + _BATCH], **{n: found[n].sum(axis=1) for n in names}}))
    return pd.concat(parts, ignore_index=True)


def is_linear(name: str, weights: tuple[float, float] = TVERSKY_WEIGHTS) -> bool:
    """Whether, for given set sizes, a coefficient is linear in the shared bits, so that its mean needs no pairs."""
    return name in ("dice", "cosine", "russel", "kulczynski", "mcconnaughey") or name == "tversky" and sum(weights) == 1


def _linear_means(q: DataFrame, c: DataFrame, n_context: int, n_bits: int, names: Sequence[str], weights, schema: str) -> DataFrame:
    """Sums of linear coefficients from the context's counts per bit and set size: work grows with queries + context."""
    sized = c.select(F.size(F.coalesce("bits", F.array().cast("array<int>"))).alias("size"), F.explode_outer("bits").alias("bit"))
    # At most one row for each bit and set size, both bounded by the width.
    held = sized.groupBy("size", "bit").agg(F.count(F.lit(1)).alias("n")).toPandas()
    sizes = np.sort(held["size"].unique())
    rows = c.groupBy(F.size(F.coalesce("bits", F.array().cast("array<int>"))).alias("size")).count().toPandas()
    of_size = rows.set_index("size")["count"].reindex(sizes).to_numpy(np.float64)
    held = held.dropna()
    table = np.zeros((n_bits, len(sizes)), np.float32 if n_context < 1 << 24 else np.float64)
    table[held["bit"].to_numpy(np.int64), np.searchsorted(sizes, held["size"].to_numpy())] = held["n"].to_numpy()
    shared = q.sparkSession.sparkContext.broadcast((table, sizes.astype(np.float64), of_size))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, b, n = shared.value
        for batch in batches:
            sums = {name: np.zeros(len(batch)) for name in names}
            for i, bits in enumerate(batch["bits"]):
                own = np.asarray(bits if bits is not None else [], np.int64)
                a, common = float(len(own)), counts[own].sum(0, dtype=np.float64)
                # Linear in c: the sum over n rows of one size is n times the value at their mean c.
                for name, value in coefficients(a, b, common / n, n_bits, weights).items():
                    if name in sums:
                        sums[name][i] = (value * n).sum()
            yield pd.DataFrame({"id": batch["id"].to_numpy("int64"), **sums})

    return q.mapInPandas(scan, schema)


def mean_similarities(
    queries: DataFrame, context: DataFrame, key: str, context_key: str, bits: str = "bits", n_bits: int = FINGERPRINT_BITS,
    names: Sequence[str] = COEFFICIENTS, weights: tuple[float, float] = TVERSKY_WEIGHTS,
    block_rows: int = BLOCK_ROWS, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Mean of each coefficient per query over the whole context.

    Coefficients linear in the shared bits come from a table of counts; only the
    others meet every context row. Context sets have at most ``n_bits`` elements below
    ``n_bits``; the table is made only where the width bounds it to ``LINEAR_BYTES``.
    """
    linear = [n for n in names if is_linear(n, weights)] if 8 * n_bits * (n_bits + 1) <= LINEAR_BYTES else []
    rest = [n for n in names if n not in linear]
    q = queries.select(F.col(key).cast("bigint").alias("id"), F.col(bits).alias("bits"))
    c = materialize(context.select(F.col(context_key).cast("bigint").alias("id"), F.col(bits).alias("bits")), "context")
    n_context = c.count()
    if not n_context:
        raise ValueError("the context is empty")
    if linear:
        schema = "id bigint, " + ", ".join(f"{n} double" for n in linear)
        sums = _linear_means(q, c, n_context, n_bits, linear, weights, schema)
        means = sums.select(F.col("id").alias(key), *[(F.col(n) / n_context).alias(n) for n in linear])
        if not rest:
            return means.select(key, *names)
        others = mean_similarities(queries, c, key, "id", "bits", n_bits, rest, weights, block_rows, slice_rows)
        return means.join(others, key).select(key, *names)
    schema = "id bigint, " + ", ".join(f"{n} double" for n in names)
    if fits_rows(c, block_rows) and block_rows * n_bits * 4 <= BLOCK_BYTES:
        shared = q.sparkSession.sparkContext.broadcast(list(c.toPandas()["bits"]))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = _dense(shared.value, n_bits)
            for b in batches:
                if len(b):
                    yield _sums(b["id"].to_numpy("int64"), list(b["bits"]), held, n_bits, names, weights)

        sums = q.mapInPandas(scan, schema)
    else:
        q = materialize(q, "queries")
        blocks, slices = blocks_for(n_context, block_rows), blocks_for(q.count(), slice_rows)
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        one_of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        left = q.select("id", "bits", one_of(slices).alias("slice"), all_of(blocks).alias("block"))
        right = c.select("id", "bits", one_of(blocks).alias("block"), all_of(slices).alias("slice"))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"id": np.array([], "int64"), **{n: np.array([], "float64") for n in names}})
            return _sums(a["id"].to_numpy("int64"), list(a["bits"]), _dense(list(b["bits"]), n_bits), n_bits, names, weights)

        parts = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(meet, schema)
        sums = parts.groupBy("id").agg(*[F.sum(n).alias(n) for n in names])
    return sums.select(F.col("id").alias(key), *[(F.col(n) / n_context).alias(n) for n in names])


def minhash_codes(sets: DataFrame, trees: int, hashes: int) -> DataFrame:
    """Sort codes of (id, bits) rows: per tree, ``hashes`` minima in a row, taken within the row."""

    def least(i: int) -> Column:
        return F.array_min(F.transform("bits", lambda x: F.xxhash64(x, F.lit(i))))

    codes = F.array(*[
        F.struct(F.lit(i).alias("tree"), *[least(i * hashes + j).alias(f"code{j}") for j in range(hashes)])
        for i in range(trees)])
    return sets.where(F.size("bits") > 0).select("id", F.inline(codes))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def xxhash64(values: np.ndarray, seed=42) -> np.ndarray:
    """Spark's ``xxhash64`` of 64-bit or 32-bit whole numbers, which takes the hash of the columns before as seed."""
    seed, width = np.atleast_1d(np.asarray(seed, np.int64)).view(np.uint64), values.dtype.itemsize
    x = values.astype(np.int64).view(np.uint64)
    if width == 8:
        return _mixed(_turned((seed + _P5 + np.uint64(8)) ^ _turned(x * _P2, 31) * _P1, 27) * _P1 + _P4).view(np.int64)
    x = (seed + _P5 + np.uint64(4)) ^ (x & np.uint64(0xFFFFFFFF)) * _P1
    return _mixed(_turned(x, 23) * _P2 + _P3).view(np.int64)


def minima(values: np.ndarray, starts: np.ndarray, codes: int) -> np.ndarray:
    """The codes of ``minhash_codes``, a row per set; sets begin at ``starts`` and aren't empty."""
    once = xxhash64(values)
    return np.stack([np.minimum.reduceat(xxhash64(np.array([i], np.int32), once), starts) for i in range(codes)], axis=1)


class HeldContext:
    """The sets of a context as places in the list of their values, and its order in every tree."""

    def __init__(self, rows: pd.DataFrame, kind: type, trees: int, hashes: int):
        rows = rows.sort_values("id", kind="stable", na_position="first")
        self.known = rows["id"].notna().to_numpy()
        self.ids = np.array([-(1 << 63) if pd.isna(i) else int(i) for i in rows["id"].astype(object)], np.int64)
        sets = [np.asarray(x, kind) for x in rows["bits"]]
        self.n = np.array([len(x) for x in sets], np.int64)
        self.start = np.cumsum(self.n) - self.n
        flat = np.concatenate(sets) if sets else np.zeros(0, kind)
        self.values, self.at = np.unique(flat, return_inverse=True)
        codes = minima(flat, self.start, trees * hashes).reshape(len(sets), trees, hashes) if sets else np.zeros((0, trees, hashes), np.int64)
        # Rows of equal codes stay in order of id.
        self.order = np.stack([np.lexsort(codes[:, t].T[::-1]) for t in range(trees)])
        self.codes = np.stack([codes[at, t] for t, at in enumerate(self.order)])
        #: Rows of one id stand together and are all compared if one of them is met.
        self.same = [np.searchsorted(self.ids, self.ids, side) for side in ("left", "right")]

    def met(self, codes: np.ndarray, width: int) -> list[np.ndarray]:
        """Of each query the context rows next to it in some tree."""
        trees, rows = self.order.shape
        tree = np.arange(trees)
        low, high = np.zeros(codes.shape[:2], np.int64), np.full(codes.shape[:2], rows)
        while (low < high).any():
            mid = (low + high) // 2
            there = self.codes[tree, np.minimum(mid, rows - 1)]
            upto = np.ones(low.shape, bool)
            for j in range(codes.shape[2] - 1, -1, -1):
                upto = (there[..., j] < codes[..., j]) | (there[..., j] == codes[..., j]) & upto
            low, high = np.where((low < high) & upto, mid + 1, low), np.where((low < high) & ~upto, mid, high)
        at = low[..., None] + np.arange(-width, width)
        inside = (at >= 0) & (at < rows)
        found = np.where(inside, self.order[tree[:, None], np.clip(at, 0, rows - 1)], -1).reshape(len(codes), -1)
        out = []
        for own in found:
            own = np.unique(own[own >= 0])
            own = own[self.known[own]]
            a, b = (side[own] for side in self.same)
            if (b - a > 1).any():
                own = np.unique(np.concatenate([np.arange(i, j) for i, j in zip(a, b)]))
                own = own[self.known[own]]
            out.append(own)
        return out

    def best(self, values: np.ndarray, starts: np.ndarray, width: int, threshold: float) -> list[tuple[int, float] | None]:
        """Of each query set, none of them empty, the id and coefficient of its best match."""
        n = np.diff(np.append(starts, len(values)))
        out: list[tuple[int, float] | None] = [None] * len(starts)
        if not len(self.ids):
            return out
        place = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        shared = self.values[place] == values
        some = np.nonzero(np.add.reduceat(shared, starts, dtype=np.int64))[0]
        if not len(some):
            return out
        # Others share nothing with any row.
        keep = np.repeat(np.isin(np.arange(len(starts)), some), n)
        ends = np.cumsum(n[some])
        codes = minima(values[keep], ends - n[some], self.codes.shape[0] * self.codes.shape[2])
        marked = np.zeros(len(self.values), bool)
        for i, own in zip(some.tolist(), self.met(codes.reshape(len(some), *self.codes.shape[::2]), width)):
            if not len(own):
                continue
            part = slice(starts[i], starts[i] + n[i])
            mine = place[part][shared[part]]
            marked[mine] = True
            size = self.n[own]
            first = np.cumsum(size) - size
            common = np.add.reduceat(marked[self.at[np.repeat(self.start[own] - first, size) + np.arange(size.sum())]], first, dtype=np.int64)
            marked[mine] = False
            jaccard = common / (n[i] + size - common)
            jaccard[(common == 0) | (jaccard < threshold)] = -1.0
            top = jaccard.max()
            if top >= 0:
                out[i] = int(self.ids[own[jaccard == top]].min()), float(top)
        return out


def _held_matches(queries: DataFrame, held: HeldContext, kind: type, width: int, threshold: float) -> DataFrame:
    shared = queries.sparkSession.sparkContext.broadcast(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = shared.value
        for batch in batches:
            n = np.nan_to_num(batch["bits"].value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            n[~batch["id"].is_valid().to_numpy(zero_copy_only=False)] = 0
            best: list[tuple[int, float] | None] = [None] * len(n)
            full = np.nonzero(n)[0]
            # Some rows at a time: as many values as a processor's cache takes.
            for part in np.split(full, np.nonzero(np.diff(np.cumsum(n[full]) // _VALUES))[0] + 1):
                if len(part):
                    values = batch["bits"].take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(kind)
                    for i, m in zip(part.tolist(), context.best(values, np.cumsum(n[part]) - n[part], width, threshold)):
                        best[i] = m
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array([m and m[0] for m in best], pa.int64()), pa.array([m[1] if m else 0.0 for m in best], pa.float64())],
                ["query_id", "context_id", "jaccard"])

    return queries.mapInArrow(scan, "query_id bigint, context_id bigint, jaccard double")


def best_matches(
    queries: DataFrame, context: DataFrame, trees: int = 24, hashes: int = 2, width: int = 1, threshold: float = 0.0,
    held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """Approximate best Jaccard match of every query, with the exact coefficient.

    Both tables are (id, bits) rows, the bits distinct. Rows next to each other in an
    order by MinHash minima are compared, so no bucket is ever expanded. A query without a
    candidate that shares a bit has a null match and coefficient 0.

    A context whose codes and sets take ``held_bytes`` at most is held by every task. Queries
    that share their id with others are compared as one, by joins, as is all with a larger context.
    """
    queries, kinds = queries.select("id", "bits"), {"array<bigint>": np.int64, "array<int>": np.int32}
    context = materialize(context.select("id", "bits"), "sets")
    absent = lambda df: F.exists("bits", F.isnull) if df.schema["bits"].dataType.containsNull else F.lit(False)
    usable = context.where(F.size("bits") > 0)
    rows, values, gaps = usable.agg(F.count(F.lit(1)), F.sum(F.size("bits")), F.count_if(absent(usable))).head()
    kind, types = dict(queries.dtypes)["bits"], {dict(d.dtypes)["id"] for d in (queries, context)}
    fits = kind in kinds and kind == dict(context.dtypes)["bits"] and types == {"bigint"} and not gaps
    if not fits or 8 * (rows * (trees * hashes + trees + 6) + 3 * (values or 0)) > held_bytes:
        return _joined_matches(queries, context, trees, hashes, width, threshold)
    found = usable.collect()  # numbers with nulls among them would become floats in pandas
    held = HeldContext(pd.DataFrame({"id": pd.array([r["id"] for r in found], "Int64"), "bits": [r["bits"] for r in found]}), kinds[kind], trees, hashes)
    odd = queries.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max(absent(queries)).alias("_gap")).where(
        F.col("id").isNotNull() & ((F.col("_n") > 1) | F.col("_gap"))).select("id")
    odd = materialize(odd, "repeated")
    if not odd.head():
        return _held_matches(queries, held, kinds[kind], width, threshold)
    alone = _held_matches(queries.join(odd, "id", "left_anti"), held, kinds[kind], width, threshold)
    return alone.unionByName(_joined_matches(queries.join(odd, "id", "left_semi"), context, trees, hashes, width, threshold))


def _joined_matches(queries: DataFrame, context: DataFrame, trees: int, hashes: int, width: int, threshold: float) -> DataFrame:
    """The same for a context of any size, by a shared order of both sides; ``context`` is a written table."""
    queries = materialize(queries, "sets")
    order = [f"code{j}" for j in range(hashes)]
    pairs = adjacent_in_order(minhash_codes(context, trees, hashes), minhash_codes(queries, trees, hashes), order, width)
    with_sets = pairs.join(context.select(F.col("id").alias("context_id"), F.col("bits").alias("_b")), "context_id").join(
        queries.select(F.col("id").alias("query_id"), F.col("bits").alias("_a")), "query_id")
    shared = with_sets.select(
        "query_id", "context_id", F.size(F.array_intersect("_a", "_b")).alias("c"), (F.size("_a") + F.size("_b")).alias("n"))
    scored = shared.withColumn("jaccard", F.col("c") / (F.col("n") - F.col("c"))).where((F.col("c") > 0) & (F.col("jaccard") >= threshold))
    best = scored.groupBy("query_id").agg(F.max_by(F.struct("context_id", "jaccard"), F.struct("jaccard", -F.col("context_id"))).alias("_m"))
    return queries.select(F.col("id").alias("query_id")).join(best, "query_id", "left").select(
        "query_id", F.col("_m.context_id").alias("context_id"), F.coalesce("_m.jaccard", F.lit(0.0)).alias("jaccard"))
