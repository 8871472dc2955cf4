"""Boosted trees on gradient histograms, with leaf penalties, early stopping and continued fits.

Features are coded once as a byte each, by approximate quantiles of all rows. The coded
rows, with their labels, weights and margins, are a written stage table. To grow a level
of a tree, every task adds up gradients, hessians and rows per node, feature and bin;
the driver adds up those of few tasks, Spark those of many, and running sums over the bins
of a feature give the gain of every split. After a tree the table is written
anew with the margins it gives, so no round repeats the work of earlier ones and a lost
executor costs a task; the table before is deleted.

Equal coded rows have equal gradients. If the distinct ones are few enough for the driver,
as where many rows share the features of few entities, it grows the trees on these, each
weighted by its rows, without a job a level.

Several targets on the same rows are grown side by side: their histograms are one job.

A saved ensemble is continued on other rows: their margins start at what its trees give
them. ``fit_over_parts`` does so part by part, saving after each; a run that was cut goes
on with the first part that isn't saved.

A row without a label for a target has no weight in it. A feature that is null or NaN
counts as larger than all others.
"""

from __future__ import annotations

import dataclasses
import json
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stage import discard, materialize, path_exists, spread

BINS = 64
#: Sums of a level that all tasks together send to the driver, and rows that it may hold.
SENT_BYTES, HELD_BYTES = 64 << 20, 64 << 20


@dataclasses.dataclass(frozen=True)
class Settings:
    """The defaults are those of the studied fits."""

    rounds: int = 20
    depth: int = 10
    leaves: int = 31
    rate: float = 0.01
    min_rows: int = 1000
    l1: float = 0.3
    l2: float = 0.3
    min_hessian: float = 1e-3
    balance: bool = True
    patience: int = 5


@dataclasses.dataclass
class Tree:
    """Nodes as lists; ``feature`` is -1 in a leaf, and a row goes left if its bin is at most ``bin``."""

    feature: list[int]
    bin: list[int]
    left: list[int]
    right: list[int]
    value: list[float]

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.bin, self.left, self.right))
        at = np.zeros(len(bins), dtype=np.int64)
        while True:
            inner = np.nonzero(feature[at] >= 0)[0]
            if not len(inner):
                return at
            node = at[inner]
            goes = bins[inner, feature[node]] <= cut[node]
            at[inner] = np.where(goes, left[node], right[node])

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.walk(bins)]


@dataclasses.dataclass
class Ensemble:
    """Trees per target on one coding of the features."""

    targets: list[str]
    edges: list[list[float]]
    base: list[float]
    trees: list[list[Tree]]

    def code(self, features: np.ndarray) -> np.ndarray:
        """A byte per feature: the number of edges below the value."""
        return np.stack([np.searchsorted(e, features[:, f], side="left") for f, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        """A column of log odds per target."""
        out = np.tile(np.array(self.base), (len(bins), 1))
        for t, trees in enumerate(self.trees):
            for tree in trees:
                out[:, t] += tree.margins(bins)
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """A row per tree; its text form is exact for doubles."""
        rows = [("", -1, json.dumps({"edges": self.edges, "base": self.base, "targets": self.targets}))]
        rows += [(name, i, json.dumps(dataclasses.asdict(tree))) for name, trees in zip(self.targets, self.trees) for i, tree in enumerate(trees)]
        spark.createDataFrame(rows, "target string, tree int, form string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ensemble:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["tree"])
        head = json.loads(rows[0]["form"])
        trees = [[Tree(**json.loads(r["form"])) for r in rows[1:] if r["target"] == name] for name in head["targets"]]
        return cls(head["targets"], head["edges"], head["base"], trees)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in row] for row in column], dtype=np.float64)


def _full(column: pd.Series) -> np.ndarray:
    """A matrix of lists of one length without nulls, as stage tables have them."""
    return np.concatenate(column.to_list()).reshape(len(column), -1)


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), -1)


def bin_edges(rows: DataFrame, features: str, bins: int = BINS) -> list[list[float]]:
    """Per feature the upper bounds of all bins but the last: its distinct quantiles, few if its values are."""
    x = rows.select(F.col(features).cast("array<double>").alias("x")).where("x is not null")
    first = x.select(F.size("x").alias("n")).head()
    if first is None:
        raise ValueError("there is no row to learn from")
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    out = []
    for at in range(0, first["n"], 256):  # the summaries of so many features are held at once
        asked = [F.percentile_approx(F.get("x", F.lit(i)), shares, F.lit(1000)) for i in range(at, min(at + 256, first["n"]))]
        out += [sorted({v for v in c or [] if not math.isnan(v)}) for c in x.agg(*asked).head()]
    return out


def coded(rows: DataFrame, features: str, labels: Sequence[Column], ensemble: Ensemble, weights: Sequence[float], validation: Column | None) -> DataFrame:
    """The stage table of a fit: bytes, labels, weights, margins so far, and whether a row only validates."""
    plain = rows.select(
        F.col(features).cast("array<double>").alias("_x"), F.array(*[c.cast("double") for c in labels]).alias("_y"),
        (F.lit(False) if validation is None else F.coalesce(validation, F.lit(False))).alias("_val"))
    pos = np.array(weights)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                bins, y = ensemble.code(_matrix(b["_x"])), _matrix(b["_y"])
                w = np.where(np.isnan(y), 0.0, np.where(y > 0, pos, 1.0))
                yield pd.DataFrame({
                    "bins": [r.tobytes() for r in bins], "y": list(np.nan_to_num(y)), "w": list(w),
                    "margin": list(ensemble.margins(bins)), "val": b["_val"]})

    return plain.mapInPandas(code, TABLE)


TABLE = "bins binary, y array<double>, w array<double>, margin array<double>, val boolean"


def node_sums(batches: Iterator[pd.DataFrame], trees: dict[int, Tree], nodes: dict[int, list[int]], width: int) -> dict[int, np.ndarray]:
    """Per target the gradients, hessians and rows of a task by feature, node and bin."""
    sums = {t: np.zeros((3, width, len(at) * BINS)) for t, at in nodes.items()}
    for b in batches:
        b = b[~b["val"]]
        if len(b):
            add_rows(sums, trees, nodes, _bytes(b["bins"]), _full(b["y"]), _full(b["w"]), _full(b["margin"]))
    return sums


def add_rows(
    sums: dict[int, np.ndarray], trees: dict[int, Tree], nodes: dict[int, list[int]], bins: np.ndarray, y: np.ndarray, w: np.ndarray,
    m: np.ndarray, n: np.ndarray | None = None,
) -> None:
    """Add rows, each counting ``n`` times, to the sums of their nodes."""
    for t, at in nodes.items():
        slot = np.full(len(trees[t].feature), -1)
        slot[at] = np.arange(len(at))
        own = slot[trees[t].walk(bins)]
        use = np.nonzero((own >= 0) & (w[:, t] > 0))[0]
        if not len(use):
            continue
        p = 1.0 / (1.0 + np.exp(-m[use, t]))
        g, h = w[use, t] * (p - y[use, t]), w[use, t] * p * (1.0 - p)
        times = None if n is None else n[use]
        if n is not None:
            g, h = g * times, h * times
        first = own[use] * BINS
        for f in range(bins.shape[1]):
            place = first + bins[use, f]
            for k, value in enumerate((g, h, times)):
                sums[t][k, f] += np.bincount(place, weights=value, minlength=len(at) * BINS)


class HeldRows:
    """The distinct rows of a fit, on the driver; ``n`` says how many rows each stands for."""

    def __init__(self, rows: pd.DataFrame):
        self.bins, self.y, self.w, self.m = _bytes(rows["bins"]), _full(rows["y"]), _full(rows["w"]), _full(rows["margin"])
        self.val, self.n = rows["val"].to_numpy(bool), rows["n"].to_numpy(float)

    @classmethod
    def of(cls, table: DataFrame, width: int, targets: int) -> HeldRows | None:
        """None if there are too many, or no rows."""
        most = HELD_BYTES // (width + 24 * targets + 64)
        some = table.groupBy("bins", "y", "w", "margin", "val").agg(F.count(F.lit(1)).alias("n")).limit(most + 1)
        some = materialize(some, "distinct")
        found = None if not 0 < some.count() <= most else cls(some.toPandas())
        discard(some)
        return found

    def sums(self, trees: dict[int, Tree], nodes: dict[int, list[int]]) -> dict[int, np.ndarray]:
        out = {t: np.zeros((3, self.bins.shape[1], len(at) * BINS)) for t, at in nodes.items()}
        use = ~self.val
        add_rows(out, trees, nodes, self.bins[use], self.y[use], self.w[use], self.m[use], self.n[use])
        return out

    def add(self, trees: dict[int, Tree]) -> None:
        for t, tree in trees.items():
            self.m[:, t] += tree.margins(self.bins)

    def losses(self, val: bool) -> list[float | None]:
        z = np.where(self.y > 0, -self.m, self.m)
        n = self.n[:, None] * (self.w > 0) * (self.val == val)[:, None]
        loss = (n * (np.maximum(z, 0.0) + np.log1p(np.exp(-np.abs(z))))).sum(axis=0)
        return [float(x / k) if k else None for x, k in zip(loss, n.sum(axis=0))]


def histograms(table: DataFrame, trees: dict[int, Tree], nodes: dict[int, list[int]], width: int) -> DataFrame:
    """Sums (t, node, feature, bin, g, h, n) over the training rows in the given nodes of each target's tree."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = node_sums(batches, trees, nodes, width)
        for t, at in nodes.items():
            f, place = np.nonzero(sums[t][2])
            yield pd.DataFrame({
                "t": np.int32(t), "node": np.array(at, dtype="int32")[place // BINS], "feature": f.astype("int32"),
                "bin": (place % BINS).astype("int32"), "g": sums[t][0, f, place], "h": sums[t][1, f, place],
                "n": sums[t][2, f, place].astype("int64")})

    found = table.mapInPandas(add, "t int, node int, feature int, bin int, g double, h double, n bigint")
    # Tasks have summed their bins already; dealt by feature, the sums and the running sums need one shuffle.
    return found.repartition("t", "node", "feature").groupBy("t", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def sent_sums(table: DataFrame, trees: dict[int, Tree], nodes: dict[int, list[int]], width: int) -> dict[int, np.ndarray]:
    """The sums of few tasks, added up by the driver."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = node_sums(batches, trees, nodes, width)
        yield pd.DataFrame({"t": np.array([*sums], "int32"), "sums": [x.tobytes() for x in sums.values()]})

    total = {t: np.zeros((3, width, len(at) * BINS)) for t, at in nodes.items()}
    for r in table.mapInPandas(add, "t int, sums binary").collect():
        total[r["t"]] += np.frombuffer(r["sums"]).reshape(total[r["t"]].shape)
    return total


def held_splits(total: dict[int, np.ndarray], nodes: dict[int, list[int]], s: Settings) -> list[dict]:
    """What ``best_splits`` gives, from sums on the driver."""

    def strength(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(g) - s.l1, 0.0) ** 2 / (h + s.l2)

    out = []
    for t, at in nodes.items():
        sums = total[t].reshape(*total[t].shape[:2], len(at), BINS)
        left = sums.cumsum(axis=3)
        whole = left[..., -1:]
        (lg, lh, ln), (ag, ah, _), (rg, rh, rn) = left, whole, whole - left
        fits = (np.minimum(ln, rn) >= s.min_rows) & (np.minimum(lh, rh) >= s.min_hessian) & (sums[2] > 0)
        gain = np.floor((strength(lg, lh) + strength(rg, rh) - strength(ag, ah)) * 1e9 + 0.5) / 1e9
        gain = np.where(fits & (gain > 0), gain, 0.0)
        for i, node in enumerate(at):
            if not whole[2, :, i].any():
                continue
            # The first feature and bin of the largest gain.
            f, b = np.unravel_index(gain[:, i].argmax(), gain[:, i].shape)
            best = {"gain": float(gain[f, i, b]), "f": -int(f), "b": -int(b)} | {
                k: float(v[f, i, b]) for k, v in (("lg", lg), ("lh", lh), ("rg", rg), ("rh", rh))} if gain[f, i, b] > 0 else None
            out.append({"t": t, "node": node, "best": best, "all": {"ag": float(ag[-1, i, 0]), "ah": float(ah[-1, i, 0])}})
    return out


def best_splits(sums: DataFrame, s: Settings) -> DataFrame:
    """Per node its totals and the best split that both sides allow (null if there is none)."""
    by = W.partitionBy("t", "node", "feature")
    upto = by.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # a feature's bins at most
    run = sums.select("t", "node", "feature", "bin", *[F.sum(c).over(upto).alias(f"l{c}") for c in "ghn"], *[F.sum(c).over(by).alias(f"a{c}") for c in "ghn"])
    run = run.select("*", *[(F.col(f"a{c}") - F.col(f"l{c}")).alias(f"r{c}") for c in "ghn"])

    def strength(side: str) -> Column:
        shrunk = F.greatest(F.abs(F.col(f"{side}g")) - s.l1, F.lit(0.0))
        return shrunk * shrunk / (F.col(f"{side}h") + s.l2)

    fits = (F.least("ln", "rn") >= s.min_rows) & (F.least("lh", "rh") >= s.min_hessian)
    gain = F.round(strength("l") + strength("r") - strength("a"), 9)
    # Equal gains go to the first feature and bin, so a rerun grows the same tree.
    chosen = F.when(fits & (gain > 0), F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "lg", "lh", "rg", "rh"))
    return run.groupBy("t", "node").agg(F.max(chosen).alias("best"), F.max(F.struct("feature", "ag", "ah")).alias("all"))


def leaf_value(g: float, h: float, s: Settings) -> float:
    """The step of a leaf: what the penalties leave of the gradient, over the hessian, times the rate."""
    return -math.copysign(max(abs(g) - s.l1, 0.0), g) / (h + s.l2) * s.rate


def grow(table: DataFrame | HeldRows, targets: Sequence[int], width: int, s: Settings) -> dict[int, Tree]:
    """The next tree of each target, level by level; of a level's splits the best are made while leaves are left."""
    trees = {t: Tree([-1], [0], [0], [0], [0.0]) for t in targets}
    frontier = {t: [0] for t in targets}
    tasks = 0 if isinstance(table, HeldRows) else table.rdd.getNumPartitions()
    for level in range(s.depth):
        if isinstance(table, HeldRows):
            rows = held_splits(table.sums(trees, frontier), frontier, s)
        elif tasks * 24 * BINS * width * sum(map(len, frontier.values())) <= SENT_BYTES:
            rows = held_splits(sent_sums(table, trees, frontier, width), frontier, s)
        else:
            rows = best_splits(histograms(table, trees, frontier, width), s).collect()
        frontier = {}
        for t in targets:
            tree = trees[t]
            own = sorted((r for r in rows if r["t"] == t), key=lambda r: (-(r["best"]["gain"] if r["best"] else 0.0), r["node"]))
            room = s.leaves - sum(f < 0 for f in tree.feature)
            for r in own:
                if level == 0:
                    tree.value[0] = leaf_value(r["all"]["ag"], r["all"]["ah"], s)
                if not r["best"] or room < 1:
                    continue
                room -= 1
                best, node = r["best"], r["node"]
                tree.feature[node], tree.bin[node] = -best["f"], -best["b"]
                tree.left[node], tree.right[node] = len(tree.feature), len(tree.feature) + 1
                for side in "lr":
                    tree.feature.append(-1), tree.bin.append(0), tree.left.append(0), tree.right.append(0)
                    tree.value.append(leaf_value(best[f"{side}g"], best[f"{side}h"], s))
                frontier.setdefault(t, []).extend([tree.left[node], tree.right[node]])
            if room < 1:
                frontier.pop(t, None)  # no split of these could be made
        if not frontier:
            break
    return trees


def with_margins(table: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """The table with what new trees add to the margins."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                bins, m = _bytes(b["bins"]), _full(b["margin"])
                for t, tree in trees.items():
                    m[:, t] += tree.margins(bins)
                yield b.assign(margin=list(m))

    return table.mapInPandas(add, TABLE)


def log_losses(table: DataFrame, targets: int, val: bool) -> list[float | None]:
    """Mean log loss per target over the validating (or training) rows, each counting once."""
    y, m, w = (lambda t, c=c: F.get(c, F.lit(t)) for c in ("y", "margin", "w"))
    z = lambda t: F.when(y(t) > 0, -m(t)).otherwise(m(t))
    loss = lambda t: F.greatest(z(t), F.lit(0.0)) + F.log1p(F.exp(-F.abs(z(t))))
    row = table.where(F.col("val") == val).agg(*[F.avg(F.when(w(t) > 0, loss(t))).alias(f"l{t}") for t in range(targets)]).head()
    return list(row)


def start(rows: DataFrame, features: str, labels: Sequence[Column], names: Sequence[str], s: Settings, validation: Column | None) -> tuple[Ensemble, list[float]]:
    """An ensemble without trees, and the weight of a positive row per target."""
    train = rows if validation is None else rows.where(~F.coalesce(validation, F.lit(False)))
    counts = train.agg(*[F.count_if(c.cast("double") > 0) for c in labels], *[F.count(c) for c in labels]).head()
    pos, n = np.array(counts[: len(labels)], dtype=float), np.array(counts[len(labels) :], dtype=float)
    weight = np.where((pos > 0) & s.balance, (n - pos) / np.maximum(pos, 1), 1.0)
    held = pos * weight
    base = np.log(np.maximum(held, 1e-9) / np.maximum(n - pos, 1e-9)) * ((pos > 0) & (pos < n))
    return Ensemble(list(names), bin_edges(train, features), base.tolist(), [[] for _ in names]), weight.tolist()


def fit(
    rows: DataFrame, features: str, targets: dict[str, str | Column], settings: Settings = Settings(), validation: Column | None = None,
    ensemble: Ensemble | None = None, report: list | None = None,
) -> Ensemble:
    """Grow trees for all targets; with ``validation`` a target stops when its rows stop improving and keeps its best.

    With ``ensemble`` its trees are kept and new ones are added to it. ``report`` receives
    the log losses on the validating rows (training rows without them) after every round.
    """
    s = settings
    labels = [F.col(c) if isinstance(c, str) else c for c in targets.values()]
    fresh, weights = start(rows, features, labels, list(targets), s, validation)
    model = fresh if ensemble is None else Ensemble(ensemble.targets, ensemble.edges, ensemble.base, [list(t) for t in ensemble.trees])
    width = len(model.edges)
    written = materialize(coded(rows, features, labels, model, weights, validation), "coded")
    held = HeldRows.of(written, width, len(labels))
    table = held or spread(written)
    known = [len(t) for t in model.trees]
    # Without validation nothing but a report asks for the losses.
    judged = validation is not None or report is not None
    lost = lambda: held.losses(validation is not None) if held else log_losses(table, len(labels), validation is not None)
    losses = lost() if judged else [None] * len(labels)
    best = {t: (math.inf if losses[t] is None else losses[t], known[t]) for t in range(len(labels))}
    active = list(range(len(labels)))
    for step in range(s.rounds):
        grown = grow(table, active, width, s)
        # A tree that can't split ends its target's fit.
        grown = {t: tree for t, tree in grown.items() if len(tree.feature) > 1}
        if not grown:
            break
        for t, tree in grown.items():
            model.trees[t].append(tree)
        if not judged and step + 1 == s.rounds:
            break
        if held:
            held.add(grown)
        else:
            before, written = written, materialize(with_margins(table, grown), "margins")
            table = written
            discard(before)
        losses = lost() if judged else losses
        if report is not None:
            report.append(losses)
        active = []
        for t in grown:
            if losses[t] is not None and losses[t] < best[t][0]:
                best[t] = (losses[t], len(model.trees[t]))
            if validation is None or losses[t] is None or len(model.trees[t]) - best[t][1] < s.patience:
                active.append(t)
        if not active:
            break
    discard(written)
    if validation is not None:
        model.trees = [trees[: best[t][1]] if best[t][0] < math.inf else trees for t, trees in enumerate(model.trees)]
    return model


def score(model: Ensemble, rows: DataFrame, features: str, keys: Sequence[str]) -> DataFrame:
    """``score_<target>``, the probability of the positive class, beside the keys, in one pass."""
    names = [f"score_{t.lower()}" for t in model.targets]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema] + [f"`{c}` double" for c in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p = 1.0 / (1.0 + np.exp(-model.margins(model.code(_matrix(b["_x"])))))
                yield b.drop(columns="_x").assign(**{c: p[:, t] for t, c in enumerate(names)})

    return rows.select(*keys, F.col(features).cast("array<double>").alias("_x")).mapInPandas(run, schema)


def fit_over_parts(
    spark: SparkSession, parts: Sequence[Callable[[], DataFrame]], features: str, targets: dict[str, str | Column], path: str,
    settings: Settings = Settings(rounds=10),
) -> Ensemble:
    """Continue one ensemble over parts of the rows in turn, saved below ``path`` after each.

    A part is read only when its turn comes, and not at all if the ensemble after it is
    saved: what a cut run has finished is not fitted again.
    """
    model = None
    for i, part in enumerate(parts):
        at = f"{path}/after-{i:05d}"
        if path_exists(spark, f"{at}/_SUCCESS"):
            model = Ensemble.load(spark, at)
        else:
            model = fit(part(), features, targets, settings, ensemble=model)
            model.save(spark, at)
    return model
