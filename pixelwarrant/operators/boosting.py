"""Gradient-boosted trees, many models at once: folds, block subsets and seeds grow side by side over one binned table.

A model is a set of training rows, a set of validation rows and the columns it may use. Features are cut into bins once. Each level of
a round is one job for all models: tasks add gradients up in histograms (model, node, feature, bin), the partial histograms are
summed by a shuffle, and each node's best cut comes back, a row for each model and node. The driver holds trees and cuts, never rows.
Validation AUC is exact, and growing stops once no model has improved for `patience` rounds; each model keeps its best rounds.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelwarrant.operators import ranks
from pixelwarrant.operators.bootstrap import uniforms
from pixelwarrant.session import durable

TRAIN, VALIDATE = 1, 2


@dataclass(frozen=True)
class Settings:
    """Fixed values as defaults; `bins` of a feature, and `check`: rounds from one look at the validation rows to the next."""

    rounds: int = 800
    depth: int = 6
    step: float = 0.05
    subsample: float = 0.8
    l2: float = 1.0
    least_weight: float = 1.0
    patience: int = 50
    bins: int = 32
    check: int = 5
    seed: int = 42


@dataclass(frozen=True)
class Model:
    """Which rows train it, which choose its number of rounds (none: all rounds), and the columns it sees (none: all)."""

    train: Column
    validate: Column | None = None
    columns: Sequence[int] | None = None


@dataclass
class Tree:
    """Nodes as a heap: the children of i are 2i+1 and 2i+2. `feature` is -1 at a leaf; rows of a bin above `bin` go right."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            right = bins[rows, np.maximum(f, 0)] > self.bin[node]
            node = np.where(inner, 2 * node + 1 + right, node)


@dataclass
class Ensemble:
    names: list[str]
    cuts: list[np.ndarray]
    trees: dict[str, list[Tree]] = field(default_factory=dict)
    gains: dict[str, dict[int, float]] = field(default_factory=dict)
    best: dict[str, int] = field(default_factory=dict)
    history: list[tuple] = field(default_factory=list)  # round, model, validation AUC

    def kept(self, name: str) -> list[Tree]:
        return self.trees[name][: self.best.get(name, len(self.trees[name]))]


def cut_points(rows: DataFrame, features: str, bins: int) -> list[np.ndarray]:
    """Quantiles of each feature, at most `bins - 1`; one row a feature comes back."""
    long = rows.select(F.posexplode(features).alias("pos", "v"))
    shares = [i / bins for i in range(1, bins)]
    found = long.groupBy("pos").agg(F.percentile_approx(F.col("v").cast("double"), shares, 10_000).alias("cuts")).orderBy("pos").collect()
    return [np.unique(r["cuts"]) for r in found]


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The number of cuts below each value."""
    return np.stack([np.searchsorted(c, values[:, i], "left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * width:
        raise ValueError(f"feature arrays must hold {width} numbers each")
    return flat.reshape(-1, width)


def _table(rows: DataFrame, models: dict[str, Model], features: str, label: str, key: str, cuts: list[np.ndarray]) -> DataFrame:
    """key, y, the role of the row in every model, and its bins as bytes."""
    role = lambda m: F.when(m.train, TRAIN).when(m.validate if m.validate is not None else F.lit(False), VALIDATE).otherwise(0).cast("byte")
    source = rows.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("y"), F.array(*[role(m) for m in models.values()]).alias("roles"), F.col(features).alias("features"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(_matrix(batch.column(3), len(cuts)), cuts)
            packed = pa.array([b.tobytes() for b in bins], pa.binary())
            roles = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(len(bins), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in roles], pa.binary()), packed], ["key", "y", "roles", "bins"])

    return durable(source.mapInArrow(run, "key long, y int, roles binary, bins binary"))


def _unpacked(batch: pa.RecordBatch, models: int, width: int) -> tuple[np.ndarray, ...]:
    y = batch.column(1).to_numpy(zero_copy_only=False)
    take = lambda c, n: np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, n)
    return batch.column(0).to_numpy(zero_copy_only=False), y, take(batch.column(2), models), take(batch.column(3), width)


def _margin(trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bins))
    for tree in trees:
        out += tree.value[tree.leaves(bins)]
    return out


def _histograms(table: DataFrame, ensemble: Ensemble, growing: dict[str, Tree], models: dict[str, Model], ratio: dict[str, float], level: int, turn: int, s: Settings) -> DataFrame:
    """model, node, feature, bin, and the sums of gradients and curvatures there, of one level."""
    width, names = len(ensemble.cuts), ensemble.names
    columns = [np.arange(width) if models[n].columns is None else np.asarray(models[n].columns) for n in names]
    before = [ensemble.trees[n] for n in names]
    trees = [growing[n] for n in names]
    ratios = [ratio[n] for n in names]
    base, nodes, depth_bins = 2**level - 1, 2**level, 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            key, y, roles, bins = _unpacked(batch, len(names), width)
            drawn = uniforms(key, turn + 1, s.seed)[:, turn] < s.subsample if s.subsample < 1 else np.ones(len(key), bool)
            for m, own in enumerate(columns):
                used = (roles[:, m] == TRAIN) & drawn
                node = trees[m].leaves(bins[used]) - base
                here = (node >= 0) & (node < nodes) & (trees[m].feature[np.maximum(node, 0) + base] == -1)
                rows, node = bins[used][here], node[here]
                if not len(rows):
                    continue
                p = 1 / (1 + np.exp(-_margin(before[m], rows)))
                t = y[used][here]
                weight = np.where(t == 1, ratios[m], 1.0)
                place = ((node[:, None] * len(own) + np.arange(len(own))) * depth_bins + rows[:, own]).ravel()
                size = nodes * len(own) * depth_bins
                for i, part in enumerate((weight * (p - t), weight * p * (1 - p))):
                    total = np.bincount(place, np.repeat(part, len(own)), size)
                    sums.setdefault(2 * m + i, np.zeros(size))
                    sums[2 * m + i] += total
        for m, own in enumerate(columns):
            if 2 * m in sums:
                g, h = sums[2 * m], sums[2 * m + 1]
                at = np.flatnonzero(h)
                node, rest = np.divmod(at, len(own) * depth_bins)
                feature, bin_ = np.divmod(rest, depth_bins)
                arrays = [np.full(len(at), m, np.int32), node.astype(np.int32), own[feature].astype(np.int32), bin_.astype(np.int32), g[at], h[at]]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["model", "node", "feature", "bin", "g", "h"])

    parts = table.mapInArrow(run, "model int, node int, feature int, bin int, g double, h double")
    return parts.groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_cuts(histograms: DataFrame, s: Settings) -> DataFrame:
    """The cut of most gain for each model and node, ties to the lower feature and bin; gain null where none is allowed."""
    upto = Window.partitionBy("model", "node", "feature").orderBy("bin")
    whole = Window.partitionBy("model", "node", "feature")
    left = histograms.withColumns({"gl": F.sum("g").over(upto), "hl": F.sum("h").over(upto), "gt": F.sum("g").over(whole), "ht": F.sum("h").over(whole)})
    gr, hr = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    score = lambda g, h: g * g / (h + s.l2)
    allowed = (F.col("hl") >= s.least_weight) & (hr >= s.least_weight)
    gain = F.when(allowed, F.round(score(F.col("gl"), F.col("hl")) + score(gr, hr) - score(F.col("gt"), F.col("ht")), 9))
    rows = left.withColumn("gain", F.when(gain > 0, gain))
    order = F.struct(F.coalesce("gain", F.lit(-1.0)), -F.col("feature"), -F.col("bin"))
    return rows.groupBy("model", "node").agg(F.max_by(F.struct("feature", "bin", "gain", "gl", "hl", "gt", "ht"), order).alias("cut")).select("model", "node", "cut.*")


def _grow(table: DataFrame, ensemble: Ensemble, models: dict[str, Model], ratio: dict[str, float], turn: int, s: Settings) -> None:
    """One more tree for every model."""
    size = 2 ** (s.depth + 1) - 1
    growing = {n: Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for n in ensemble.names}
    for level in range(s.depth):
        split = False
        for r in best_cuts(_histograms(table, ensemble, growing, models, ratio, level, turn, s), s).collect():  # a row for each model and node
            name = ensemble.names[r["model"]]
            tree, at = growing[name], 2**level - 1 + r["node"]
            leaf = lambda g, h: -s.step * g / (h + s.l2)
            tree.value[at] = leaf(r["gt"], r["ht"])
            if r["gain"] is not None:
                split = True
                tree.feature[at], tree.bin[at] = r["feature"], r["bin"]
                tree.value[2 * at + 1] = leaf(r["gl"], r["hl"])
                tree.value[2 * at + 2] = leaf(r["gt"] - r["gl"], r["ht"] - r["hl"])
                gains = ensemble.gains.setdefault(name, {})
                gains[r["feature"]] = gains.get(r["feature"], 0.0) + r["gain"]
        if not split:
            break
    for n in ensemble.names:
        ensemble.trees[n].append(growing[n])


def _validation(table: DataFrame, ensemble: Ensemble) -> dict[str, float]:
    """Exact AUC of every model on its validation rows."""
    names, width = ensemble.names, len(ensemble.cuts)
    trees = [ensemble.trees[n] for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, y, roles, bins = _unpacked(batch, len(names), width)
            for m in range(len(names)):
                used = roles[:, m] == VALIDATE
                score = _margin(trees[m], bins[used])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), m, np.int32)), pa.array(score), pa.array(y[used].astype(np.int32))], ["model", "score", "y"])

    scored = table.mapInArrow(run, "model int, score double, y int")
    return {names[r["model"]]: r["auc"] for r in ranks.auc(scored, ["model"], "score", "y").collect() if r["auc"] is not None}


def fit(
    rows: DataFrame, models: dict[str, Model], settings: Settings = Settings(), features: str = "features", label: str = "y", key: str = "sample_id", cuts: list[np.ndarray] | None = None
) -> Ensemble:
    """Grow all `models` together. `key` is a whole number of each row, which its part in a round's subsample goes by."""
    cuts = cut_points(rows, features, settings.bins) if cuts is None else cuts
    ensemble = Ensemble(list(models), cuts, {n: [] for n in models})
    table = _table(rows, models, features, label, key, cuts)
    counts = rows.agg(*[F.count_if(m.train & (F.col(label) == v)).alias(f"{i}_{v}") for i, m in enumerate(models.values()) for v in (0, 1)]).first()
    ratio = {n: counts[f"{i}_0"] / max(counts[f"{i}_1"], 1) for i, n in enumerate(models)}
    best: dict[str, tuple[float, int]] = {}
    for turn in range(settings.rounds):
        _grow(table, ensemble, models, ratio, turn, settings)
        if (turn + 1) % settings.check and turn + 1 < settings.rounds:
            continue
        for name, auc in _validation(table, ensemble).items():
            ensemble.history.append((turn + 1, name, auc))
            if name not in best or auc > best[name][0]:
                best[name] = (auc, turn + 1)
        if len(best) == len(models) and all(turn + 1 - at >= settings.patience for _, at in best.values()):
            break
    ensemble.best = {n: at for n, (_, at) in best.items()}
    return ensemble


def score(ensemble: Ensemble, rows: DataFrame, features: str = "features") -> DataFrame:
    """The rows once for every model, with `model` and P(label 1) as `pred`."""
    kept = [(n, ensemble.kept(n)) for n in ensemble.names]
    cuts = ensemble.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(_matrix(batch.column(0), len(cuts)), cuts)
            preds = np.stack([1 / (1 + np.exp(-_margin(trees, bins))) for _, trees in kept], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(preds), pa.list_(pa.float64()))], ["_row", "_preds"])

    rest = F.struct(*[F.col(c) for c in rows.columns])
    done = rows.select(F.col(features), rest.alias("_row")).mapInArrow(run, T.StructType([T.StructField("_row", rows.schema), T.StructField("_preds", T.ArrayType(T.DoubleType()))]))
    each = done.select("_row.*", F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in ensemble.names]).alias("model"), F.col("_preds").alias("pred"))).alias("_m"))
    return each.select(*rows.columns, "_m.model", "_m.pred")


def top_features(ensemble: Ensemble, spark: SparkSession, k: int = 20, names: Sequence[str] | None = None) -> DataFrame:
    """The `k` columns with the most gain, over the named models or all."""
    total: dict[int, float] = {}
    for name in names or ensemble.names:
        for f, g in ensemble.gains.get(name, {}).items():
            total[f] = total.get(f, 0.0) + g
    ranked = sorted(total.items(), key=lambda p: (-p[1], p[0]))[:k]
    return spark.createDataFrame([(int(f), float(g)) for f, g in ranked], "position int, gain double")


def save(ensemble: Ensemble, spark: SparkSession, path: str) -> None:
    """Trees and cuts as tables; a row for each node and each cut."""
    nodes = [(n, t, i, int(f), int(b), float(v)) for n in ensemble.names for t, tree in enumerate(ensemble.kept(n)) for i, (f, b, v) in enumerate(zip(tree.feature, tree.bin, tree.value))]
    spark.createDataFrame(nodes, "model string, tree int, node int, feature int, bin int, value double").write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(ensemble.cuts)], "feature int, cuts array<double>").write.mode("overwrite").parquet(f"{path}/cuts")


def load(spark: SparkSession, path: str) -> Ensemble:
    cuts = [np.array(r["cuts"]) for r in spark.read.parquet(f"{path}/cuts").orderBy("feature").collect()]
    found: dict[str, dict[int, list]] = {}
    for r in spark.read.parquet(f"{path}/nodes").orderBy("model", "tree", "node").collect():
        found.setdefault(r["model"], {}).setdefault(r["tree"], []).append((r["feature"], r["bin"], r["value"]))
    trees = {n: [Tree(*(np.array(c) for c in zip(*nodes))) for _, nodes in sorted(each.items())] for n, each in found.items()}
    return Ensemble(list(trees), cuts, trees)
