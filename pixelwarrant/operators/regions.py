"""Suspicious regions of a labelled map: extraction, descriptors, masks."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelwarrant.operators import grid
from pixelwarrant.operators.components import label_components
from pixelwarrant.operators.heatmap import AI, NON_AI, UNCERTAIN
from pixelwarrant.session import durable

REGION = ("image_id", "region_id")


def grown_mask(cells: DataFrame, grow: int = 3, close_radius: int = 2) -> DataFrame:
    """Confident cells grown into uncertain ones, never into confident non-AI ones (`grown`)."""
    allowed = F.col("label") != NON_AI
    core = cells.withColumn("_core", F.col("label") == AI)
    spread = grid.dilate(core, "_core", grow, "_d").withColumn("grown", F.col("_d") & allowed).drop("_core", "_d")
    if close_radius <= 0:
        return spread
    closed = grid.close(spread, "grown", close_radius, "_c")
    return closed.withColumn("grown", F.col("_c") & allowed).drop("_c")


def ranked_components(
    members: DataFrame, scales: Sequence[int], min_area_frac: float = 0.004, max_regions: int | None = None
) -> DataFrame:
    """Map statistics per component; those above the area floor ranked by area x strength.

    `members` are the cells of every component with `heat, support, disagreement, per_scale`
    and the frame size `frame_w, frame_h`.
    """
    frame = F.max("frame_w") * F.max("frame_h")
    base = members.groupBy("image_id", "component").agg(
        F.count(F.lit(1)).alias("area_px"),
        (F.count(F.lit(1)) / frame).alias("area_frac"),
        F.struct(
            F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1")
        ).alias("bbox"),
        F.avg("x").alias("centroid_x"),
        F.avg("y").alias("centroid_y"),
        F.avg("heat").alias("mean_score"),
        F.max("heat").alias("max_score"),
        F.percentile("heat", 0.9).alias("p90_score"),
        F.stddev_pop("heat").alias("heat_std"),
        F.create_map(
            *[e for s in scales for e in (F.lit(int(s)), F.avg(F.try_element_at("per_scale", F.lit(int(s)))))]
        ).alias("scale_profile"),
        F.avg("disagreement").alias("scale_disagreement"),
        F.avg("support").alias("support"),
        F.max("frame_w").alias("frame_w"),
        F.max("frame_h").alias("frame_h"),
    )
    kept = base.where((F.col("area_frac") >= min_area_frac) & F.col("mean_score").isNotNull())
    mass = F.round(F.col("area_frac") * F.col("mean_score"), 12)
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(mass.desc(), "component"))
    box = F.col("bbox")
    return (
        kept.withColumn("region_id", rank)
        .where(F.lit(True) if max_regions is None else F.col("region_id") <= max_regions)
        .withColumn("fill_ratio", F.col("area_px") / ((box["x1"] - box["x0"]) * (box["y1"] - box["y0"])))
        .withColumn(
            "touches_border",
            (box["x0"] == 0) | (box["y0"] == 0) | (box["x1"] == F.col("frame_w")) | (box["y1"] == F.col("frame_h")),
        )
    )


def region_grid(regions: DataFrame, cells: DataFrame, halo: int, ring: int, extra: str | None = None) -> DataFrame:
    """A dense grid over each region's padded box, with its inside, rim, halo and ring cells.

    Only the cells near a region are expanded. One join brings every cell column (with the
    cell's component); one exchange on the region then serves both axes and the sums after.
    `extra` names a nullable box column whose cells are added to the region (a face box).
    """
    pad = max(halo, ring, 1)
    span = lambda lo, hi, side: F.sequence(F.greatest(F.lit(0), F.col(lo) - pad), F.least(F.col(side), F.col(hi) + pad) - 1)
    box = F.col("bbox")
    if extra:
        other = F.col(extra)
        box = F.struct(
            *[F.least(box[n], F.coalesce(F.greatest(F.lit(0), other[n]), box[n])).alias(n) for n in ("x0", "y0")],
            F.greatest(box["x1"], F.coalesce(F.least(F.col("frame_w"), other["x1"]), box["x1"])).alias("x1"),
            F.greatest(box["y1"], F.coalesce(F.least(F.col("frame_h"), other["y1"]), box["y1"])).alias("y1"),
        )
    keep = [*REGION, "_own"] + ([extra] if extra else [])
    base = regions.withColumns({"_own": F.col("component"), "_box": box})
    rows = base.select(*keep, "_box", "frame_w", F.explode(span("_box.y0", "_box.y1", "frame_h")).alias("y"))
    dense = rows.select(*keep, "y", F.explode(span("_box.x0", "_box.x1", "frame_w")).alias("x"))
    joined = dense.join(cells.drop("frame_w", "frame_h", "grown", "per_scale"), ["image_id", "y", "x"])
    own = F.coalesce(F.col("component") == F.col("_own"), F.lit(False))
    if extra:
        f = F.col(extra)
        boxed = (F.col("x") >= f["x0"]) & (F.col("x") < f["x1"]) & (F.col("y") >= f["y0"]) & (F.col("y") < f["y1"])
        own = own | F.coalesce(boxed, F.lit(False))
    flagged = joined.withColumn("_in", own.cast("int"))
    flagged = flagged.repartition(*REGION)
    row, col = Window.partitionBy(*REGION, "y").orderBy("x"), Window.partitionBy(*REGION, "x").orderBy("y")
    one_axis = flagged.withColumns(
        {
            "_near": F.min("_in").over(row.rangeBetween(-1, 1)),
            "_halo": F.max("_in").over(row.rangeBetween(-halo, halo)),
            "_ring": F.max("_in").over(row.rangeBetween(-ring, ring)),
            "_side": F.coalesce(F.lag("_in").over(row), F.lit(0)) + F.coalesce(F.lead("_in").over(row), F.lit(0)),
        }
    )
    two_axes = one_axis.withColumns(
        {
            "_near": F.min("_near").over(col.rangeBetween(-1, 1)),
            "_halo": F.max("_halo").over(col.rangeBetween(-halo, halo)),
            "_ring": F.max("_ring").over(col.rangeBetween(-ring, ring)),
            "_side": F.col("_side")
            + F.coalesce(F.lag("_in").over(col), F.lit(0))
            + F.coalesce(F.lead("_in").over(col), F.lit(0)),
        }
    )
    inside = F.col("_in") == 1
    return two_axes.select(
        "*",
        inside.alias("inside"),
        (inside & (F.col("_near") == 0)).alias("rim"),
        (~inside & (F.col("_halo") == 1)).alias("halo"),
        (~inside & (F.col("_ring") == 1)).alias("ring"),
        F.when(inside, 4 - F.col("_side")).otherwise(0).alias("exposed"),
    ).drop("_own", "_in", "_near", "_halo", "_ring", "_side", "component")


def rim_descriptors(local: DataFrame) -> DataFrame:
    """Boundary sharpness, perimeter and halo uncertainty of each region."""
    perimeter = F.sum("exposed")
    return local.groupBy(*REGION).agg(
        F.coalesce(F.avg(F.when(F.col("rim"), F.col("gradient"))), F.lit(0.0)).alias("boundary_sharpness"),
        perimeter.alias("perimeter"),
        F.coalesce(
            F.avg(F.when(F.col("halo"), (F.col("label") == UNCERTAIN).cast("double"))), F.lit(0.0)
        ).alias("uncertain_halo_frac"),
        F.coalesce(
            F.try_divide(4.0 * math.pi * F.count_if(F.col("inside")), (perimeter * perimeter).cast("double")), F.lit(0.0)
        ).alias("compactness"),
    )


def with_frame(cells: DataFrame) -> DataFrame:
    whole = Window.partitionBy("image_id")
    return cells.withColumns({"frame_w": F.max("x").over(whole) + 1, "frame_h": F.max("y").over(whole) + 1})


def map_gradient(cells: DataFrame) -> DataFrame:
    """Gradient of the map, uncovered cells standing at the image mean."""
    mean = F.coalesce(F.avg("heat").over(Window.partitionBy("image_id")), F.lit(0.5))
    filled = cells.withColumn("_h", F.coalesce("heat", mean))
    return grid.gradient(filled, "_h").drop("_h")


def extract_regions(
    cells: DataFrame,
    scales: Sequence[int],
    min_area_frac: float = 0.004,
    grow: int = 3,
    close_radius: int = 2,
    halo: int = 6,
    ring: int = 8,
    max_regions: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Regions with all descriptors, their cells, the local grid around each, and all cells.

    `cells` holds `image_id, y, x, heat, label, support, disagreement, per_scale`. The cells
    with their component, and the few regions per image, are read by several later stages,
    so both are checkpointed instead of being computed again for each of them.
    """
    grown = grown_mask(with_frame(map_gradient(grid.by_image(cells))), grow, close_radius)
    components = label_components(grown, "grown")
    framed = durable(grown.join(components, ["image_id", "y", "x"], "left"))
    members = framed.where(F.col("component").isNotNull())
    kept = durable(ranked_components(members, scales, min_area_frac, max_regions))
    region_cells = members.select("image_id", "y", "x", "component").join(
        kept.select("image_id", "component", "region_id"), ["image_id", "component"]
    ).drop("component")
    local = region_grid(kept, framed, halo, ring)
    described = durable(kept.join(rim_descriptors(local), list(REGION)))
    return described, region_cells, local, framed


# --- masks --------------------------------------------------------------------------------


def mask_metrics(cells: DataFrame, predicted: Column, truth: Column, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """IoU, precision, recall, F1 and area shares of two masks on one grid."""
    num = lambda c: F.sum(c.cast("double"))
    sums = cells.groupBy(*keys).agg(
        num(predicted & truth).alias("_i"),
        num(predicted | truth).alias("_u"),
        num(predicted).alias("_p"),
        num(truth).alias("_t"),
        F.count(F.lit(1)).cast("double").alias("_n"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    i, u, p, t, n = (F.col(c) for c in ("_i", "_u", "_p", "_t", "_n"))
    return sums.select(
        *keys,
        ratio(i, u).alias("iou"),
        ratio(i, p).alias("precision"),
        ratio(i, t).alias("recall"),
        ratio(2 * i, p + t).alias("f1"),
        (p / n).alias("pred_area_frac"),
        (t / n).alias("true_area_frac"),
    )


def predicted_mask(region_cells: DataFrame, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> DataFrame:
    """Union of an image's regions at the original size."""
    union = region_cells.select("image_id", "y", "x").distinct()
    return grid.resample_nearest(union, from_w, from_h, to_w, to_h)


def match_faces(regions: DataFrame, region_cells: DataFrame, faces: DataFrame, min_overlap: float = 0.35) -> DataFrame:
    """The face box that covers the largest share of each region, if it covers enough.

    Boxes meet regions on the image, and only a box that overlaps a region's own box goes on
    to that region's cells.
    """
    boxes = faces.select("image_id", F.struct("x0", "y0", "x1", "y1").alias("face"))
    near = (
        (F.col("face.x0") < F.col("bbox.x1"))
        & (F.col("face.x1") > F.col("bbox.x0"))
        & (F.col("face.y0") < F.col("bbox.y1"))
        & (F.col("face.y1") > F.col("bbox.y0"))
    )
    pairs = regions.select(*REGION, "bbox", "area_px").join(boxes, "image_id").where(near).drop("bbox")
    hit = (
        (F.col("x") >= F.col("face.x0"))
        & (F.col("x") < F.col("face.x1"))
        & (F.col("y") >= F.col("face.y0"))
        & (F.col("y") < F.col("face.y1"))
    )
    covered = (
        region_cells.join(pairs, list(REGION))
        .where(hit)
        .groupBy(*REGION, "face", "area_px")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("face_overlap", F.col("_c") / F.col("area_px"))
    )
    best = covered.groupBy(*REGION).agg(F.max(F.struct("face_overlap", "face")).alias("_b"))
    return best.select(*REGION, F.col("_b.face").alias("face"), F.col("_b.face_overlap").alias("face_overlap")).where(
        F.col("face_overlap") >= min_overlap
    )


def region_evidence(cells: DataFrame, high: float, min_area_frac: float, heat: str = "heat") -> DataFrame:
    """Strongest mean of any component above `high` that is large enough; 0 when there is none."""
    whole = cells.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    hot = cells.withColumn("_on", F.coalesce(F.col(heat) >= high, F.lit(False)))
    parts = label_components(hot, "_on").join(cells.select("image_id", "y", "x", F.col(heat).alias("_h")), ["image_id", "y", "x"])
    means = parts.groupBy("image_id", "component").agg(F.count(F.lit(1)).alias("_a"), F.avg("_h").alias("_m"))
    best = (
        means.join(whole, "image_id").where(F.col("_a") / F.col("_n") >= min_area_frac).groupBy("image_id").agg(F.max("_m").alias("score"))
    )
    return whole.select("image_id").join(best, "image_id", "left").fillna(0.0, ["score"])


def region_reductions(
    cells: DataFrame,
    heat: str = "heat",
    highs: Sequence[float] = (0.5, 0.6, 0.7, 0.75, 0.8, 0.9),
    areas: Sequence[float] = (0.002, 0.01, 0.04),
) -> DataFrame:
    """One score per map, threshold and least area, in long form: the strongest mean of the components that are large enough, else 0.

    All thresholds are labelled in one pass, a map and threshold being one mask.
    """
    levels = F.explode(F.array(*[F.lit(h) for h in highs])).alias("high")
    tall = cells.select(F.col("image_id").alias("_image"), "y", "x", F.col(heat).alias("_h"), levels)
    tall = tall.withColumn("image_id", F.struct("_image", "high"))
    hot = tall.withColumn("_on", F.coalesce(F.col("_h") >= F.col("high"), F.lit(False)))
    parts = label_components(hot, "_on").join(tall.select("image_id", "y", "x", "_h"), ["image_id", "y", "x"])
    means = parts.groupBy("image_id", "component").agg(F.count(F.lit(1)).alias("_a"), F.avg("_h").alias("_m"))
    whole = tall.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    best = means.join(whole, "image_id").groupBy("image_id").agg(*[F.max(F.when(F.col("_a") / F.col("_n") >= a, F.col("_m"))).alias(f"a{i}") for i, a in enumerate(areas)])
    scored = whole.join(best, "image_id", "left")
    name = lambda a: F.concat(F.lit("region_hi"), F.col("image_id.high").cast("string"), F.lit(f"_area{a}"))
    each = F.explode(F.array(*[F.struct(name(a).alias("reduction"), F.coalesce(F.col(f"a{i}"), F.lit(0.0)).alias("score")) for i, a in enumerate(areas)])).alias("_r")
    return scored.select(F.col("image_id._image").alias("image_id"), each).select("image_id", "_r.reduction", "_r.score")
