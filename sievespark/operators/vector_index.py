"""A saved index for approximate nearest neighbours: inverted lists of product-quantised codes.

Layout, as Parquet below one folder: ``lists`` holds a row per vector (id, code of a byte
per two dimensions, the vector), partitioned by cell; ``model`` holds the cells' centres,
the code books and the settings. The model is written last, so an index without it is
not complete and is built again.

Build: cells and books are learned on a bounded sample (``SAMPLE_ROWS``, drawn by hash,
so a rebuild finds the same rows); every row is then placed and coded where it is, and
shuffled once to its cell. The number of cells follows the square root of the rows. The
number of cells a search visits is measured on the sample, so that a stated share of the
true neighbours lies in them: spread-out data get more visits than clustered ones.

Search: a query travels as its code to its nearest cells; codes meet codes, and each block
returns the best few by coded distance. The best of these over all cells are compared
exactly, with the vectors in the lists. A cell of many rows is cut into blocks, and the
queries that visit it into slices, so that no task holds more than one of each.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stage import materialize, path_exists
from .sampling import sample_exact

SAMPLE_ROWS, SAMPLE_PER_CELL = 8_192, 16
MAX_CELLS = 4_096
#: Dimensions per byte of a code, and the values a byte has.
PART, VALUES = 2, 256
#: The share of true neighbours whose cells are visited, on the sample.
SHARE = 0.98
#: Candidates compared exactly per neighbour asked for.
RERANK = 4
LIST_ROWS, BLOCK_ROWS, SLICE_ROWS = 1 << 20, 1 << 16, 1 << 14
_WORK_BYTES = 128 << 20
_ROUNDS = 8


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between two sets of rows, by one matrix product."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * (a @ b.T), 0.0)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of every row, in bounded memory."""
    step = max(1, _WORK_BYTES // (8 * len(centres)))
    parts = [squared_distances(rows[i : i + step], centres).argmin(axis=1) for i in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = _ROUNDS) -> np.ndarray:
    """k centres by Lloyd's rounds; a centre that loses its rows moves to a random one."""
    centres = rows[rng.choice(len(rows), k, replace=len(rows) < k)].astype(np.float64)
    for _ in range(rounds):
        at = _nearest(rows, centres)
        count = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, weights=c, minlength=k) for c in rows.T], axis=1)
        full = count > 0
        centres[full] = total[full] / count[full, None]
        centres[~full] = rows[rng.choice(len(rows), int((~full).sum()))]
    return centres


@dataclasses.dataclass
class Quantiser:
    """Centres of the cells, a book of values per two dimensions, and the cells to visit."""

    cells: np.ndarray
    books: np.ndarray
    probes: int

    def split(self, rows: np.ndarray) -> np.ndarray:
        """Rows cut into parts of PART dimensions; an odd last one gets a zero."""
        short = -rows.shape[1] % PART
        return np.pad(rows, ((0, 0), (0, short))).reshape(len(rows), -1, PART)

    def encode(self, rows: np.ndarray) -> np.ndarray:
        parts = self.split(rows)
        return np.stack([_nearest(parts[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def decode(self, codes: pd.Series) -> np.ndarray:
        raw = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), -1)
        return self.books[np.arange(raw.shape[1]), raw].reshape(len(raw), -1).astype(np.float32)


def learn(sample: np.ndarray, cells: int, k: int, share: float = SHARE, seed: int = 253) -> Quantiser:
    """Cells, books, and the visits after which ``share`` of the k nearest sample rows are found."""
    rng = np.random.default_rng(seed)
    found = Quantiser(means(sample, min(cells, len(sample)), rng), np.zeros((0, VALUES, PART)), 1)
    parts = found.split(sample)
    found.books = np.stack([means(parts[:, p], VALUES, rng) for p in range(parts.shape[1])])
    some = sample[: 512]
    d = squared_distances(some, sample)
    d[np.arange(len(some)), np.arange(len(some))] = np.inf
    near = np.argsort(d, axis=1)[:, : min(k, max(1, len(sample) - 1))]
    place = _nearest(sample, found.cells)
    order = np.argsort(np.argsort(squared_distances(some, found.cells), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(order, place[near], axis=1).ravel())
    found.probes = int(ranks[min(len(ranks) - 1, math.ceil(share * len(ranks)))]) + 1
    return found


class VectorIndex:
    """An index on disk; ``build`` writes one, ``load`` opens one, ``search`` uses it."""

    def __init__(self, spark: SparkSession, path: str, quantiser: Quantiser, schema):
        self.spark, self.path, self.quantiser = spark, path, quantiser
        self.schema = schema

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/lists")

    @classmethod
    def build(
        cls, rows: DataFrame, key: str, vector: str, path: str, k: int = 5, cells: int | None = None, share: float = SHARE, seed: int = 253
    ) -> VectorIndex:
        """Index all rows with a vector, and save the index."""
        spark = rows.sparkSession
        rows = _plain(rows, key, vector)
        n = rows.count()
        if not n:
            raise ValueError("there is no vector to index")
        cells = cells or max(1, min(MAX_CELLS, math.isqrt(n)))
        sample = sample_exact(rows, max(SAMPLE_ROWS, SAMPLE_PER_CELL * cells), "id", seed).orderBy("id").toPandas()
        quantiser = learn(_matrix(sample["vec"]), cells, k, share, seed)
        index = cls(spark, path, quantiser, "id bigint, code binary, vec array<double>, cell int")
        index._append(rows, "overwrite")
        settings = [("cell", i, v.tolist()) for i, v in enumerate(quantiser.cells)]
        settings += [("book", i, v.ravel().tolist()) for i, v in enumerate(quantiser.books)] + [("probes", quantiser.probes, [])]
        spark.createDataFrame(settings, "kind string, i int, vec array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        """Open a saved index; its model is a few rows, its lists stay where they are."""
        rows = spark.read.parquet(f"{path}/model").orderBy("kind", "i").collect()
        of = lambda kind: np.array([r["vec"] for r in rows if r["kind"] == kind])
        probes = next(r["i"] for r in rows if r["kind"] == "probes")
        books = of("book").reshape(-1, VALUES, PART)
        return cls(spark, path, Quantiser(of("cell"), books, probes), "id bigint, code binary, vec array<double>, cell int")

    @classmethod
    def load_or_build(cls, spark: SparkSession, path: str, build: Callable[[], VectorIndex]) -> VectorIndex:
        """The index saved at ``path`` if it is complete, else a new one."""
        return cls.load(spark, path) if path_exists(spark, f"{path}/model/_SUCCESS") else build()

    def add(self, rows: DataFrame, key: str, vector: str) -> None:
        """Index further rows under the model the index has."""
        self._append(_plain(rows, key, vector), "append")

    def _append(self, rows: DataFrame, mode: str) -> None:
        quantiser = self.quantiser

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    v = _matrix(b["vec"])
                    yield pd.DataFrame({
                        "id": b["id"], "code": [c.tobytes() for c in quantiser.encode(v)], "vec": b["vec"],
                        "cell": _nearest(v, quantiser.cells).astype("int32")})

        placed = materialize(rows.mapInPandas(place, self.schema), "coded")
        # A cell is written by as many tasks as its rows need.
        parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("_parts"))
        dealt = placed.join(F.broadcast(parts), "cell").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
        dealt.repartition("cell", "_part").drop("_part", "_parts").write.mode(mode).partitionBy("cell").parquet(f"{self.path}/lists")

    def candidates(self, queries: DataFrame, keep: int, probes: int) -> DataFrame:
        """(query_id, context_id, cell, rough): the ``keep`` best of every block by the distance of codes."""
        quantiser = self.quantiser

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                v = _matrix(b["vec"])
                d = squared_distances(v, quantiser.cells)
                near = np.argpartition(d, probes - 1, axis=1)[:, :probes] if probes < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(v), 1))
                code = [c.tobytes() for c in quantiser.encode(v)]
                yield pd.DataFrame({
                    "id": b["id"].repeat(near.shape[1]).to_numpy(), "code": np.repeat(np.array(code, dtype=object), near.shape[1]),
                    "cell": near.ravel().astype("int32")})

        def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(q) and len(c):
                held, ids = quantiser.decode(c["code"]), c["id"].to_numpy("int64")
                step = max(1, _WORK_BYTES // (4 * len(held)))
                for at in range(0, len(q), step):
                    part = q.iloc[at : at + step]
                    d = squared_distances(quantiser.decode(part["code"]), held)
                    best = np.argpartition(d, keep - 1, axis=1)[:, :keep] if keep < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(part), 1))
                    found.append(pd.DataFrame({
                        "query_id": part["id"].repeat(best.shape[1]).to_numpy(), "context_id": ids[best].ravel(),
                        "cell": c["cell"].iloc[0], "rough": np.take_along_axis(d, best, axis=1).ravel().astype("float32")}))
            columns = ["query_id", "context_id", "cell", "rough"]
            return pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=columns)

        routed = materialize(queries.mapInPandas(route, "id bigint, code binary, cell int"), "routed")
        # One row per cell: the blocks of its rows and the slices of its visits.
        rows = self.lists.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
        visits = routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("slices"))
        plan = F.broadcast(materialize(rows.join(visits, "cell"), "cell-plan"))
        part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = routed.join(plan, "cell").withColumn("slice", part("slices")).withColumn("block", every("blocks"))
        right = self.lists.select("id", "code", "cell").join(plan, "cell").withColumn("block", part("blocks")).withColumn("slice", every("slices"))
        keys = ["cell", "block", "slice"]
        columns = [*keys, "id", "code"]
        return left.select(*columns).groupBy(*keys).cogroup(right.select(*columns).groupBy(*keys)).applyInPandas(
            meet, "query_id bigint, context_id bigint, cell int, rough float")

    def search(self, queries: DataFrame, key: str, vector: str, k: int = 5, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
        """(query_id, context_id, dist): about the k nearest indexed rows, with exact distances."""
        queries = materialize(_plain(queries, key, vector), "queries")
        probes = min(probes or self.quantiser.probes, len(self.quantiser.cells))
        rough = self.candidates(queries, rerank * k, probes)
        order = F.row_number().over(W.partitionBy("query_id").orderBy("rough", "context_id"))
        few = rough.withColumn("_r", order).where(F.col("_r") <= rerank * k).drop("_r", "rough")
        few = materialize(few, "few")

        @F.pandas_udf("double")
        def distance(a: pd.Series, b: pd.Series) -> pd.Series:
            diff = _matrix(a) - _matrix(b)
            return pd.Series(np.sqrt((diff * diff).sum(axis=1)))

        both = few.join(self.lists.select(F.col("id").alias("context_id"), "cell", F.col("vec").alias("_c")), ["cell", "context_id"]).join(
            queries.select(F.col("id").alias("query_id"), F.col("vec").alias("_q")), "query_id")
        exact = both.select("query_id", "context_id", distance("_q", "_c").alias("dist"))
        best = F.row_number().over(W.partitionBy("query_id").orderBy("dist", "context_id"))
        return exact.withColumn("_r", best).where(F.col("_r") <= k).drop("_r")


def _plain(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``vec`` of the rows that have both."""
    plain = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    return plain.where(F.col("id").isNotNull() & F.col("vec").isNotNull())
