"""From window scores to a labelled likelihood map."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelwarrant.functions.scalar import hann

# Label codes of the three-way map.
NON_AI, UNCERTAIN, AI = 0, 1, 2


def blend_windows(scored: DataFrame, image: str = "image_id") -> DataFrame:
    """Hann-weighted blend of window scores onto the grid, per scale.

    The kernel is separable, so windows are expanded along y and summed first, and only the
    column sums are expanded along x. Both sums are grouped by the image, so a table that is
    hash-partitioned on the image is not shuffled again. A window without a score covers nothing.
    """
    tall = scored.where(F.col("score").isNotNull()).select(
        image, "scale", "x0", "x1", "y0", "y1", "score", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y")
    )
    wy = hann(F.col("y") - F.col("y0"), F.col("y1") - F.col("y0"))
    strips = tall.groupBy(image, "scale", "x0", "x1", "y").agg(
        F.sum(wy * F.col("score")).alias("_num"), F.sum(wy).alias("_den")
    )
    wide = strips.select("*", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))
    wx = hann(F.col("x") - F.col("x0"), F.col("x1") - F.col("x0"))
    return wide.groupBy(image, "scale", "y", "x").agg(
        F.sum(wx * F.col("_num")).alias("num"), F.sum(wx * F.col("_den")).alias("weight")
    ).select(image, "scale", "y", "x", (F.col("num") / F.greatest(F.col("weight"), F.lit(1e-6))).alias("heat"), "weight")


def with_support(blended: DataFrame, image: str = "image_id") -> DataFrame:
    """Accumulated weight relative to the densest cell of the same image and scale."""
    peak = F.max("weight").over(Window.partitionBy(image, "scale"))
    return blended.withColumn("support", F.coalesce(F.try_divide(F.col("weight"), peak), F.lit(0.0)))


def combine_scales(
    blended: DataFrame,
    method: str = "max",
    weights: dict[int, float] | None = None,
    scales: Sequence[int] = (),
    image: str = "image_id",
) -> DataFrame:
    """One row per cell: combined heat, mean support, scale spread and per-scale heat.

    A cell that a scale does not cover is skipped by the combination, counted as 0.5 by the
    spread, and as no support by the mean. `scales` names the scales an image was planned
    with; without it, those seen in the image are used.
    """
    if method == "max":
        heat = F.max("heat")
    elif method == "mean":
        weight = F.lit(1.0)
        for scale, w in (weights or {}).items():
            weight = F.when(F.col("scale") == scale, F.lit(float(w))).otherwise(weight)
        heat = F.sum(weight * F.col("heat")) / F.sum(F.when(F.col("heat").isNotNull(), weight))
    else:
        raise ValueError(f"unknown scale combination {method!r}")
    counted = (
        blended.withColumn("_k", F.lit(len(scales)))
        if scales
        else blended.withColumn("_k", F.size(F.collect_set("scale").over(Window.partitionBy(image))))
    )
    some_missing = F.count("heat") < F.max("_k")
    high = F.greatest(F.max("heat"), F.when(some_missing, 0.5))
    low = F.least(F.min("heat"), F.when(some_missing, 0.5))
    return counted.groupBy(image, "y", "x").agg(
        heat.alias("heat"),
        (F.sum("support") / F.max("_k")).alias("support"),
        F.when(F.max("_k") < 2, 0.0).otherwise(high - low).alias("disagreement"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("scale", "heat")))).alias("per_scale"),
    )


def three_way_label(heat: Column, support: Column, low: float = 0.45, high: float = 0.75, min_support: float = 0.15) -> Column:
    """Likely AI, likely not, or uncertain; thin support is always uncertain."""
    return (
        F.when(heat.isNull() | (support < min_support), UNCERTAIN)
        .when(heat >= high, AI)
        .when(heat <= low, NON_AI)
        .otherwise(UNCERTAIN)
        .cast("int")
    )


def map_summary(cells: DataFrame, image: str = "image_id") -> DataFrame:
    """Mean, max and 95th percentile of a map, label shares and mean scale spread."""
    share = lambda v: F.avg((F.col("label") == v).cast("double"))
    return cells.groupBy(image).agg(
        F.avg("heat").alias("mean_score"),
        F.max("heat").alias("max_score"),
        F.percentile("heat", 0.95).alias("p95_score"),
        share(AI).alias("frac_likely_ai"),
        share(UNCERTAIN).alias("frac_uncertain"),
        share(NON_AI).alias("frac_likely_non_ai"),
        F.avg("disagreement").alias("mean_scale_disagreement"),
        F.avg("support").alias("mean_support"),
    )
