"""Whitening of embeddings from polarised covariances.

Method: vectors become integers x = floor(256 c). Over the distinct x vectors, the sum
of the squares of every centred dimension and of every centred sum of two dimensions is
aggregated exactly; half the difference of variances,
(Var(a + b) - Var(a) - Var(b)) / 2, is the covariance of a and b. The matrix is
assembled in exact integers, divided once, and handed to ``eigh``.

Exactness: values are centred at the mean rounded to an integer, so that squares stay
small; what rounding left is put right with the (exact) sums of the centred values.
Batches whose sums could leave 64 bits use Python integers, and Spark adds decimals.

Scale: one shuffle brings equal vectors together, partially aggregated, so that a vector
with any number of copies is no hot key. The passes for sums, squares and the check
of the result return a row per dimension, pair or matrix entry and task. The driver
receives width and width * width / 2 numbers and the matrix, whatever the rows.

Cases: a row whose vector is null, or holds a null, a NaN or an infinity, is dropped; so
is one whose vector has another length than most have (ties: the longer). Entries beyond
2^44 count as that. A null id is an id like others and repeated rows give repeated
results. Components without variance (an eigenvalue below 1e-12 of the largest) are
not returned, so a table of one distinct vector, or an empty one, gives no rows. A
deviation that a long can't hold is null. Extra columns are not read.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import materialize

SCALE = 256
COMPONENTS = 4
LIMIT = float(1 << 44)
#: Eigenvalues below this share of the largest are rounding.
NO_VARIANCE = 1e-12
_INT64 = 1 << 62

RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x`` of the rows with finite vectors of the commonest length."""
    plain = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("c"))
    plain = plain.where(
        F.col("c").isNotNull() & F.forall("c", lambda c: F.coalesce((c == c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    )
    lengths = plain.groupBy(F.size("c").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).head()
    width = lengths["width"] if lengths else 0
    held = lambda c: F.greatest(F.least(c, F.lit(LIMIT)), F.lit(-LIMIT))
    x = F.transform("c", lambda c: F.floor(held(c) * SCALE).cast("long") + F.lit(0))
    return plain.where(F.size("c") == width).select("vec_id", x.alias("x"))


def _matrix(column: pd.Series) -> np.ndarray:
    """Integers of a batch; Python's own where 64 bits could overflow in a sum of products."""
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), -1)


def _exact(values: np.ndarray, terms: int) -> np.ndarray:
    """``values`` in a type in which ``terms`` products of two of them can be added."""
    top = int(np.abs(values).max(initial=0))
    return values if terms * top * top < _INT64 else values.astype(object)


def _long(values) -> list:
    return [int(v) for v in np.asarray(values).ravel()]


def dimension_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of every dimension."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, None
        for b in batches:
            if len(b):
                # Entries are below 2^53, so a batch's sums fit.
                sums = _matrix(b["x"]).sum(axis=0).astype(object)
                n, total = n + len(b), sums if total is None else total + sums
        if n:
            yield pd.DataFrame({"i": range(len(total)), "n": n, "total": _decimals(total)})

    found = fit.select("x").mapInPandas(add, "i int, n long, total decimal(38,0)")
    sums = found.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").cast("string").alias("total")).orderBy("i").collect()
    return (sums[0]["n"] if sums else 0), [int(r["total"]) for r in sums]


def _decimals(values) -> list:
    from decimal import Decimal

    return [Decimal(int(v)) for v in values]


def squared_sums(fit: DataFrame, centre: list[int]) -> tuple[dict, dict]:
    """Exact sums over the rows: of z per dimension, and of z_i^2 (key (i, i)) and (z_i + z_j)^2 (key (i, j))."""
    middle = np.array(centre, dtype=np.int64)
    width = len(centre)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = np.zeros(width, dtype=object)
        squares = np.zeros((width, width), dtype=object)
        for b in batches:
            if not len(b):
                continue
            z = _exact(_matrix(b["x"]) - middle, 4 * len(b))
            first += z.sum(axis=0)
            for i in range(width):
                both = z[:, i:] + z[:, i : i + 1]
                both[:, 0] = z[:, i]
                squares[i, i:] += (both * both).sum(axis=0)
        i, j = np.triu_indices(width)
        yield pd.DataFrame({
            "i": np.concatenate([i, np.arange(width)]), "j": np.concatenate([j, np.full(width, -1)]),
            "total": _decimals(np.concatenate([squares[i, j], first]))})

    found = fit.select("x").mapInPandas(add, "i int, j int, total decimal(38,0)")
    rows = found.groupBy("i", "j").agg(F.sum("total").cast("string").alias("total")).collect()
    sums = {r["i"]: int(r["total"]) for r in rows if r["j"] < 0}
    return sums, {(r["i"], r["j"]): int(r["total"]) for r in rows if r["j"] >= 0}


def polarised_covariance(n: int, sums: dict, squares: dict) -> np.ndarray:
    """The covariance matrix (divisor n) from variances of dimensions and of sums of two."""
    width = len(sums)
    # n^2 times a variance, in integers.
    own = {i: n * squares[i, i] - sums[i] ** 2 for i in range(width)}
    out = np.zeros((width, width))
    for (i, j), square in squares.items():
        if i == j:
            out[i, i] = own[i] / (n * n)
        else:
            both = n * square - (sums[i] + sums[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n * n)
    return out


@dataclasses.dataclass
class Whitening:
    """What a fit has learned; ``vectors`` holds a unit eigenvector per column, by falling ``values``."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def transform(self, x: np.ndarray) -> np.ndarray:
        """The whitened rows: (x - mean) along each component, over its deviation."""
        centred = (x * self.n - np.array(self.sums, dtype=x.dtype)).astype(np.float64) / self.n
        return centred @ (self.vectors / np.sqrt(self.values))


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of the distinct integer vectors; None if nothing varies."""
    fit = materialize(vectors.select("x").distinct(), "distinct-vectors")
    n, sums = dimension_sums(fit)
    if not n or not sums:
        return None
    centre = [(2 * s + n) // (2 * n) for s in sums]
    covariance = polarised_covariance(n, *squared_sums(fit, centre))
    values, basis = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > NO_VARIANCE * max(values.max(), 0.0)]
    if not len(order):
        return None
    basis = basis[:, order]
    # The sign is free; the entry of largest size is made positive.
    signs = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(len(order))])
    model = Whitening(n, sums, basis * signs, values[order], float(np.trace(covariance)))
    model.identity_error = identity_error(fit, model)
    return model


def _wide(x: np.ndarray, n: int) -> np.ndarray:
    """The integers in a type that holds n times each and the squares' sum over the width."""
    top = 2 * n * (int(np.abs(x).max(initial=0)) + 1)
    return x if x.shape[1] * top * top < _INT64 else x.astype(object)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(model.values)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, products = np.zeros(k), np.zeros((k, k))
        for b in batches:
            if len(b):
                w = model.transform(_wide(_matrix(b["x"]), model.n))
                first += w.sum(axis=0)
                products += w.T @ w
        yield pd.DataFrame({
            "a": np.repeat(np.arange(k + 1), k), "b": np.tile(np.arange(k), k + 1), "total": np.vstack([products, first]).ravel()})

    rows = fit.select("x").mapInPandas(add, "a int, b int, total double").groupBy("a", "b").agg(F.sum("total").alias("total"))
    full = np.zeros((k + 1, k))
    for r in rows.collect():
        full[r["a"], r["b"]] = r["total"] / model.n
    mean = full[k]
    return float(np.abs(full[:k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """A row per vector and component."""
    if model is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    k = len(model.values)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _wide(_matrix(b["x"]), model.n)
            y = x * model.n - np.array(model.sums, dtype=x.dtype)
            deviation = [v if v < 1 << 63 else None for v in _long((y * y).sum(axis=1))]
            yield pd.DataFrame({
                "vec_id": b["vec_id"].astype("Int64").repeat(k).to_numpy(), "component": np.tile(np.arange(1, k + 1, dtype="int32"), len(b)),
                "n": model.n, "deviation": pd.array(np.repeat(np.array(deviation, dtype=object), k), dtype="Int64"),
                "whitened": model.transform(x).ravel(), "explained": np.tile(model.values / model.trace, len(b)),
                "identity_error": model.identity_error})

    return vectors.mapInPandas(rows, RESULT)


def op13_polarisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along the four leading whitened components."""
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return whiten(vectors, fit_whitening(vectors))
