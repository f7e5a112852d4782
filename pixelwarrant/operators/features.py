"""Feature arrays: block layout, selection, scaling."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8
Blocks = Sequence[tuple[str, int]]


def layout(blocks: Blocks) -> list[tuple[str, int, int, int]]:
    """(name, dim, start, stop) with running offsets."""
    out, start = [], 0
    for name, dim in blocks:
        out.append((name, dim, start, start + dim))
        start += dim
    return out


def select_blocks(features: Column, blocks: Blocks, names: Sequence[str] | None) -> tuple[Column, list[tuple[str, int, int, int]]]:
    """Only the named blocks, in layout order, and their renumbered layout."""
    if not names:
        return features, layout(blocks)
    unknown = sorted(set(names) - {n for n, _ in blocks})
    if unknown:
        raise ValueError(f"unknown feature blocks {unknown}")
    kept = [(n, d, a, b) for n, d, a, b in layout(blocks) if n in names]
    return F.concat(*[F.slice(features, a + 1, d) for _, d, a, _ in kept]), layout([(n, d) for n, d, _, _ in kept])


def fit_scaler(rows: DataFrame, features: str = "features") -> DataFrame:
    """One row of per-column mean and population deviation + 1e-8.

    Vectors are unpacked and pre-aggregated by position, so only (position, sums) is shuffled.
    """
    long = rows.select(F.posexplode(features).alias("pos", "v"))
    stats = long.groupBy("pos").agg(F.avg(F.col("v").cast("double")).alias("mean"), (F.stddev_pop(F.col("v").cast("double")) + EPS).alias("std"))
    packed = stats.agg(F.sort_array(F.collect_list(F.struct("pos", "mean", "std"))).alias("_s"))
    return packed.select(F.col("_s.mean").alias("mean"), F.col("_s.std").alias("std"))


def apply_scaler(rows: DataFrame, scaler: DataFrame, features: str = "features") -> DataFrame:
    """(x - mean) / std; a width that differs from the scaler's is an error."""
    pair = scaler.select(F.struct("mean", "std")).scalar()
    staged = rows.withColumn("_s", pair)
    fits = F.size(features) == F.size("_s.mean")
    scaled = F.transform(
        F.arrays_zip(F.col(features).alias("v"), F.col("_s.mean").alias("m"), F.col("_s.std").alias("d")), lambda t: (t["v"] - t["m"]) / t["d"]
    )
    checked = F.when(fits, scaled).otherwise(F.raise_error(F.lit("feature width differs from the training scaler")))
    return staged.withColumn(features, checked).drop("_s")


def class_weight(rows: DataFrame, label: str = "y") -> DataFrame:
    """Row weights that balance the classes: positives count n_neg / max(n_pos, 1)."""
    ratio = rows.agg(
        (F.count_if(F.col(label) == 0) / F.greatest(F.count_if(F.col(label) == 1), F.lit(1))).alias("w")
    ).scalar()
    return rows.withColumn("weight", F.when(F.col(label) == 1, ratio).otherwise(1.0))
