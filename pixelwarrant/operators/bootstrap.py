"""Paired, stratified bootstrap of the AUC difference between two scores of the same rows.

Rows are first reduced to one row per (class, score pair), so ties collapse. A replicate
gives each such row a Poisson(count) weight: a number from counters (row key, replicate,
seed) sent through the inverse distribution, so a draw depends on nothing else and both
arms share it. For each arm the rows are range-partitioned by score and swept once, a chunk
of rows against all replicates at a time; a task hands on only per-replicate totals of at
most three score segments, which are then chained. No row is ever copied per replicate,
and equal scores that fall into different tasks are joined exactly.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 256
PRIME = 2147483647  # of the draws; products stay below 2**63


def uniforms(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """(rows, replicates) numbers in (0, 1): fifth powers, which are a permutation modulo PRIME, of sums of the counters."""
    k, r = keys.astype(np.int64)[:, None] % PRIME, np.arange(replicates, dtype=np.int64)[None, :]
    x = (k * 48271 + r * 69621 + seed * 16807 + 1) % PRIME
    for a, b in ((40692, 39373), (45991, 30323)):
        square = x * x % PRIME
        x = (square * square % PRIME * x + k * a + r * b) % PRIME
    return (x + 0.5) / PRIME


def poisson(u: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Poisson(count) numbers of each row's uniforms, by the inverse distribution."""
    out = np.empty_like(u)
    for n in np.unique(counts):
        top = int(n + 12 * np.sqrt(n) + 20)
        k = np.arange(top)
        cdf = np.cumsum(np.exp(-n + k * np.log(n) - np.array([lgamma(i + 1.0) for i in k])))
        at = counts == n
        out[at] = np.searchsorted(cdf, u[at].ravel(), "right").reshape(u[at].shape)
    return out


class _Arm:
    """Totals of one arm in one sorted partition: its first score, the scores in between, and its last, whose ties may go on elsewhere."""

    def __init__(self, name: str, replicates: int):
        self.name, self.low, self.first, self.held = name, None, None, None
        self.pos, self.neg = np.zeros(replicates), np.zeros(replicates)
        self.inner = [np.zeros(replicates) for _ in range(3)]  # pos, neg, wins

    def add(self, scores: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> Iterator[pd.DataFrame]:
        """Rows in order of score, with their weights as positives and as negatives."""
        starts = np.flatnonzero(np.concatenate([[True], scores[1:] != scores[:-1]]))
        own, p, n = scores[starts], np.add.reduceat(pos, starts), np.add.reduceat(neg, starts)
        if self.held is not None and self.held == own[0]:
            p[0] += self.pos
            n[0] += self.neg
        elif self.held is not None:
            own, p, n = np.append(self.held, own), np.vstack([self.pos, p]), np.vstack([self.neg, n])
        self.held, self.pos, self.neg = own[-1], p[-1].copy(), n[-1].copy()
        own, p, n = own[:-1], p[:-1], n[:-1]
        if len(own) and self.first is None:
            self.first = own[0]
            yield self.segment(own[0], 0, p[0], n[0], p[0] * n[0] / 2)
            own, p, n = own[1:], p[1:], n[1:]
        if len(own):
            self.low = own[0] if self.low is None else self.low
            below = self.inner[1] + np.cumsum(n, axis=0) - n / 2
            self.inner = [self.inner[0] + p.sum(0), self.inner[1] + n.sum(0), self.inner[2] + (p * below).sum(0)]

    def segment(self, score: float, inner: int, pos: np.ndarray, neg: np.ndarray, wins: np.ndarray) -> pd.DataFrame:
        place = np.arange(len(pos), dtype=np.int32)
        return pd.DataFrame({"arm": self.name, "score": score, "inner": inner, "replicate": place, "pos": pos, "neg": neg, "wins": wins})

    def rest(self) -> Iterator[pd.DataFrame]:
        if self.low is not None:
            yield self.segment(self.low, 1, *self.inner)
        if self.held is not None:
            yield self.segment(self.held, 0, self.pos, self.neg, self.pos * self.neg / 2)


def _sweep(replicates: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arm = None
        for batch in batches:
            for start in range(0, len(batch), CHUNK):
                part = batch.iloc[start : start + CHUNK]
                weight = poisson(uniforms(part["key"].to_numpy(), replicates, seed), part["n"].to_numpy())
                is_pos = (part["y"].to_numpy() == 1)[:, None]
                names, scores = part["arm"].to_numpy(), part["score"].to_numpy()
                for name in dict.fromkeys(names):
                    if arm is None or arm.name != name:
                        if arm is not None:
                            yield from arm.rest()
                        arm = _Arm(name, replicates)
                    own = names == name
                    yield from arm.add(scores[own], weight[own] * is_pos[own], weight[own] * ~is_pos[own])
        if arm is not None:
            yield from arm.rest()

    return run


def replicate_aucs(
    rows: DataFrame, with_score: str, without_score: str, label: str, replicates: int = 2000, seed: int = 0, key: Column | None = None
) -> DataFrame:
    """`(replicate, auc_with, auc_without, delta)`; replicates that lost a class are dropped.

    The draws of a class and score pair go by the least `key` (a whole number) of its rows; without one, by a hash of the pair.
    """
    counts = rows.groupBy(
        F.col(label).alias("y"), F.col(with_score).cast("double").alias("a"), F.col(without_score).cast("double").alias("b")
    ).agg(F.count(F.lit(1)).alias("n"), *([] if key is None else [F.min(key.cast("long")).alias("key")]))
    keyed = counts if key is not None else counts.withColumn("key", F.pmod(F.xxhash64("y", "a", "b"), F.lit(PRIME)))
    long = keyed.select(
        "key",
        "n",
        "y",
        F.explode(F.array(F.struct(F.lit("with").alias("arm"), F.col("a").alias("score")), F.struct(F.lit("without").alias("arm"), F.col("b").alias("score")))).alias("_s"),
    ).select("_s.arm", "_s.score", "y", "key", "n")
    ranged = long.repartitionByRange("arm", "score", "key").sortWithinPartitions("arm", "score", "key")
    segments = ranged.mapInPandas(
        _sweep(replicates, seed), "arm string, score double, inner int, replicate int, pos double, neg double, wins double"
    )
    # Ties cut by a partition edge meet here; an inner segment is alone in its score.
    merged = segments.groupBy("arm", "replicate", "score", "inner").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("wins").alias("wins")
    ).withColumn("wins", F.when(F.col("inner") == 0, F.col("pos") * F.col("neg") / 2).otherwise(F.col("wins")))
    before = Window.partitionBy("arm", "replicate").orderBy("score", "inner").rowsBetween(Window.unboundedPreceding, -1)
    chained = merged.withColumn("wins", F.col("wins") + F.col("pos") * F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    per = chained.groupBy("arm", "replicate").agg((F.try_divide(F.sum("wins"), F.sum("pos") * F.sum("neg"))).alias("auc"))
    one = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("auc")))
    wide = per.groupBy("replicate").agg(one("with").alias("auc_with"), one("without").alias("auc_without"))
    return wide.where(F.col("auc_with").isNotNull() & F.col("auc_without").isNotNull()).withColumn(
        "delta", F.col("auc_with") - F.col("auc_without")
    )


def paired_auc_delta(
    rows: DataFrame, with_score: str, without_score: str, label: str, replicates: int = 2000, seed: int = 0, key: Column | None = None
) -> DataFrame:
    """Observed AUCs, their difference, its 95% interval and whether that excludes zero."""
    from pixelwarrant.operators import metrics, ranks

    observed = ranks.auc(metrics.two_arms(rows, with_score, without_score, [label]), ["arm"], "score", label)
    one = lambda c, arm: F.max(F.when(F.col("arm") == arm, F.col(c)))
    point = observed.agg(
        one("auc", "with").alias("auc_with"), one("auc", "without").alias("auc_without"), one("pos", "with").alias("n_positive"), one("neg", "with").alias("n_negative")
    )
    ends = replicate_aucs(rows, with_score, without_score, label, replicates, seed, key).agg(
        F.percentile("delta", [0.025, 0.975]).alias("ci")
    )
    return point.withColumn("ci", ends.scalar()).select(
        "n_positive",
        "n_negative",
        "auc_with",
        "auc_without",
        (F.col("auc_with") - F.col("auc_without")).alias("delta"),
        F.col("ci")[0].alias("ci_low"),
        F.col("ci")[1].alias("ci_high"),
        ((F.col("ci")[0] > 0) | (F.col("ci")[1] < 0)).alias("significant"),
    )
