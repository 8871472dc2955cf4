"""Scaling, normalising and PCA of lists that are too wide for a covariance matrix.

The same chain as ``reduce.fit_reduction``. The leading components are found by orthogonal
iteration: a block of directions is multiplied by the rows and back in one pass over them
(each task adds up its part, chunks are added in Spark), and made orthonormal by a QR of
the tall block. The driver holds width x components numbers, never width x width.

The total variance is summed from the rows, so the share that components explain is known
without the others. The block is doubled until it explains the cutoff. A block as
wide as the rows gives the whole basis, so narrow lists are reduced exactly.

A list that is null is left out of the fit and stays null; a missing number counts as its
position's mean.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import materialize, spread
from .networks import summed
from .reduce import choose_components

START, EXTRA, ROUNDS = 64, 10, 4
#: The block of directions is held by every task; it bounds width x components.
BLOCK_BYTES = 512 << 20


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in row] for row in column], dtype=np.float64)


@dataclasses.dataclass
class WideReduction:
    """Means and deviations per position, the mean of the unit rows, and a component per column."""

    mean: np.ndarray
    deviation: np.ndarray
    centre: np.ndarray
    basis: np.ndarray
    cumulative: list[float]

    @property
    def components(self) -> int:
        return self.basis.shape[1]

    @property
    def explained(self) -> float:
        return self.cumulative[self.components - 1]

    def unit(self, x: np.ndarray) -> np.ndarray:
        """Standardised rows of length one; a row of zeros stays one."""
        z = np.nan_to_num((x - self.mean) / self.deviation)
        norm = np.sqrt((z * z).sum(axis=1))
        return z / np.where(norm > 0, norm, 1.0)[:, None]

    def transform(self, df: DataFrame, col: str, out: str = "reduced") -> DataFrame:
        """Add the reduced list."""
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def reduced(column: pd.Series) -> pd.Series:
            m, found = model.value, [None] * len(column)
            at = np.nonzero(column.notna().to_numpy())[0]
            if len(at):
                values = (m.unit(_matrix(column.iloc[at])) - m.centre) @ m.basis
                for i, v in zip(at, values.tolist()):
                    found[i] = v
            return pd.Series(found, dtype=object)

        return df.withColumn(out, reduced(F.col(col).cast("array<double>")))


def fit_wide_reduction(df: DataFrame, col: str, cutoff: float = 0.95, step: int | None = None, start: int = START, rounds: int = ROUNDS, seed: int = 253) -> WideReduction:
    """Fit the chain; the component count is the one ``reduce.fit_reduction`` chooses."""
    table = materialize(df.select(F.col(col).cast("array<double>").alias("x")).where("x is not null"), "wide")
    first = table.head()
    if first is None:
        raise ValueError("there is no row to learn from")
    width = len(first["x"])
    table = spread(table)

    def total(shape: tuple[int, ...], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all rows of what a batch gives."""

        def run(batches: Iterator[pd.DataFrame]) -> np.ndarray:
            found = np.zeros(shape)
            for b in batches:
                if len(b):
                    found += of(_matrix(b["x"]))
            return found.ravel()

        return summed(table, run).reshape(shape)

    n, some, known = (lambda s: (s[0, 0], s[1], np.maximum(s[2], 1)))(
        total((3, width), lambda x: np.stack([np.full(width, float(len(x))), np.nansum(x, axis=0), (~np.isnan(x)).sum(axis=0)])))
    mean = some / known
    var = total((width,), lambda x: np.nansum((x - mean) ** 2, axis=0)) / known
    model = WideReduction(mean, np.where(var > 0, np.sqrt(np.where(var > 0, var, 1.0)), np.inf), np.zeros(width), np.zeros((width, 0)), [])
    rows = model.unit
    model.centre = total((width,), lambda x: rows(x).sum(axis=0)) / n
    centred = lambda x: rows(x) - model.centre
    variance = float(total((1,), lambda x: np.array([(centred(x) ** 2).sum()]))[0])
    limit = int(min(n, width))
    size = min(start, limit)
    rng = np.random.default_rng(seed)
    block = rng.standard_normal((width, min(width, size + EXTRA)))
    while True:
        if block.nbytes > BLOCK_BYTES:
            raise ValueError("the components asked for don't fit into a task: lower the cutoff")
        for _ in range(1 if block.shape[1] == width else rounds):
            block = np.linalg.qr(block)[0]
            block = total(block.shape, lambda x: (lambda c: c.T @ (c @ block))(centred(x)))
        basis = np.linalg.qr(block)[0]
        inner = total((basis.shape[1],) * 2, lambda x: (lambda y: y.T @ y)(centred(x) @ basis))
        values, turn = np.linalg.eigh(inner)
        values, turn = np.maximum(values[::-1], 0.0), turn[:, ::-1]
        shares = np.cumsum(values / variance)[:size] if variance > 0 else np.ones(size)
        if shares[-1] >= cutoff or size == limit:
            break
        # The directions found stay; as many random ones join them.
        size = min(2 * size, limit)
        block = np.concatenate([basis @ turn, rng.standard_normal((width, max(0, min(width, size + EXTRA) - basis.shape[1])))], axis=1)
    # Beyond what was found every count explains at least as much, which is all the search asks.
    cumulative = shares.tolist() + [max(1.0, shares[-1])] * (width - len(shares))
    k = min(choose_components(cumulative, int(n), cutoff, step), size)
    model.basis, model.cumulative = (basis @ turn)[:, :k], shares.tolist()
    return model
