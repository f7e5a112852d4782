"""Multi-scale windows: planning, scoring, labelling.

Sums over a window never expand the window's cells: an integral image is built once per
image, and each window looks up its four corners.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def effective_scales(w: Column, h: Column, scales: Sequence[int], floor: int = 8) -> Column:
    """Scales clamped to the image, duplicates dropped in order."""
    short = F.least(w, h).cast("int")
    return F.array_distinct(F.transform(F.array(*[F.lit(s) for s in scales]), lambda s: F.greatest(F.lit(floor), F.least(s, short))))


def starts(length: Column, patch: Column, stride: Column) -> Column:
    """Window starts along one axis, the last one clamped to the edge."""
    last = length - patch
    grid = F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), stride), F.array(F.greatest(last, F.lit(0)))))
    return F.when(patch >= length, F.array(F.lit(0))).otherwise(grid)


def plan_windows(images: DataFrame, scales: Sequence[int], overlap: float = 0.5, floor: int = 8) -> DataFrame:
    """Every window of every scale for `images(image_id, ..., w, h)`."""
    if not 0.0 <= overlap < 1.0:
        raise ValueError(f"overlap must be in [0, 1), got {overlap}")
    w, h = F.col("w").cast("int"), F.col("h").cast("int")
    sized = images.select("*", F.explode(effective_scales(w, h, scales, floor)).alias("scale"))
    patch = F.least("scale", w, h)
    stride = F.greatest(F.lit(1), F.bround(patch * F.lit(1.0 - overlap)).cast("int"))
    keep = [c for c in images.columns if c not in ("w", "h")]
    rows = sized.select(*keep, "scale", "w", patch.alias("_p"), stride.alias("_s"), F.explode(starts(h, patch, stride)).alias("y0"))
    cols = rows.select(
        *keep, "scale", "_p", "y0", F.explode(starts(F.col("w").cast("int"), F.col("_p"), F.col("_s"))).alias("x0")
    )
    return cols.select(*keep, "scale", "x0", "y0", (F.col("x0") + F.col("_p")).alias("x1"), (F.col("y0") + F.col("_p")).alias("y1"))


def window_cells(windows: DataFrame) -> DataFrame:
    """Each cell paired with every window that covers it (rows multiply by the window area)."""
    rows = windows.select("*", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"))
    return rows.select("*", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))


def integral_image(cells: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Running 2-D totals of each expression, at every cell; one exchange serves both axes."""
    keys = list(keys)
    cells = cells.select(*keys, "y", "x", *[c.alias(n) for n, c in sums.items()]).repartition(*keys)
    along_x = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    along_y = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    rows = cells.select(*keys, "y", "x", *[F.sum(n).over(along_x).alias(n) for n in sums])
    return rows.select(*keys, "y", "x", *[F.sum(n).over(along_y).alias(n) for n in sums])


def box_sums(boxes: DataFrame, cells: DataFrame, sums: dict[str, Column], image: str = "image_id", missing: float = 0.0) -> DataFrame:
    """Sum of each expression over each box (`x1`, `y1` exclusive), from four corner look-ups.

    Cells that are not in the table, or whose expression is null, count as `missing`; an image is filled up to the
    furthest cell or box. A box is never lost.
    """
    reach = cells.select(image, "y", "x").unionByName(boxes.select(image, (F.col("y1") - 1).alias("y"), (F.col("x1") - 1).alias("x")))
    frame = reach.groupBy(image).agg(F.max("y").alias("_h"), F.max("x").alias("_w")).where("_h >= 0 and _w >= 0")
    lines = frame.select(image, "_w", F.explode(F.sequence(F.lit(0), F.col("_h").cast("int"))).alias("y"))
    blank = lines.select(image, "y", F.explode(F.sequence(F.lit(0), F.col("_w").cast("int"))).alias("x"))
    own = cells.select(image, "y", "x", *[c.cast("double").alias(n) for n, c in sums.items()])
    both = own.unionByName(blank.select("*", *[F.lit(None).cast("double").alias(n) for n in sums])).repartition(image)
    filled = both.groupBy(image, "y", "x").agg(*[F.coalesce(F.sum(n), F.lit(missing)).alias(n) for n in sums])
    table = integral_image(filled, [image], {n: F.col(n) for n in sums})
    corner = lambda y, x, sign: F.struct((F.col(y) - 1).alias("y"), (F.col(x) - 1).alias("x"), F.lit(sign).alias("sign"))
    corners = boxes.select(
        "*",
        F.explode(
            F.array(corner("y1", "x1", 1.0), corner("y0", "x1", -1.0), corner("y1", "x0", -1.0), corner("y0", "x0", 1.0))
        ).alias("_c"),
    ).select(*boxes.columns, F.col("_c.y").alias("y"), F.col("_c.x").alias("x"), F.col("_c.sign").alias("_sign"))
    joined = corners.join(table, [image, "y", "x"], "left")
    return joined.groupBy(*boxes.columns).agg(*[F.sum(F.col("_sign") * F.coalesce(n, F.lit(0.0))).alias(n) for n in sums])


def area() -> Column:
    return (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))


def window_means(boxes: DataFrame, cells: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Mean of each expression over each window of a dense grid."""
    totals = box_sums(boxes, cells, values)
    return totals.select(*boxes.columns, *[(F.col(n) / area()).alias(n) for n in values])


def smoothness_scores(boxes: DataFrame, cells: DataFrame, gray: Column, full_scale: float = 12.0) -> DataFrame:
    """A weight-free scorer: 1 minus the mean step between neighbouring cells of a window.

    `gray` is on the 0..255 scale. Only steps whose both ends lie inside the window count,
    so the last column (row) of steps is left out of the box.
    """
    along_x = Window.partitionBy("image_id", "y").orderBy("x")
    along_y = Window.partitionBy("image_id", "x").orderBy("y")
    g = cells.withColumn("_g", gray)
    stepped = g.select(
        "image_id",
        "y",
        "x",
        F.coalesce(F.abs(F.lead("_g").over(along_x) - F.col("_g")), F.lit(0.0)).alias("_dx"),
        F.coalesce(F.abs(F.lead("_g").over(along_y) - F.col("_g")), F.lit(0.0)).alias("_dy"),
    )
    # Sums over the window without its last column (dx) and without its last row (dy).
    two = boxes.select(
        *[F.col(c) for c in boxes.columns if c not in BOX],
        *[F.col(c).alias(f"_w{c}") for c in BOX],
        F.explode(
            F.array(
                F.struct(F.lit("x").alias("axis"), F.col("x0"), F.col("y0"), (F.col("x1") - 1).alias("x1"), F.col("y1")),
                F.struct(F.lit("y").alias("axis"), F.col("x0"), F.col("y0"), F.col("x1"), (F.col("y1") - 1).alias("y1")),
            )
        ).alias("_b"),
    )
    flat = two.select(*[c for c in two.columns if c != "_b"], "_b.*")
    sums = box_sums(flat, stepped, {"_sx": F.col("_dx"), "_sy": F.col("_dy")})
    base = [c for c in boxes.columns if c not in BOX]
    step = F.when(F.col("axis") == "x", F.col("_sx")).otherwise(F.col("_sy"))
    means = sums.groupBy(*base, *[f"_w{c}" for c in BOX]).agg(F.sum(F.coalesce(F.try_divide(step, area()), F.lit(0.0))).alias("_m"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("_m") / full_scale))
    return means.select(*base, *[F.col(f"_w{c}").alias(c) for c in BOX], score.alias("score"))


def label_by_centre(boxes: DataFrame, mask: DataFrame) -> DataFrame:
    """1 when the centre cell of a window lies in the mask (`image_id, y, x`), else 0."""
    centred = boxes.withColumns({"y": F.expr("int((y0 + y1) div 2)"), "x": F.expr("int((x0 + x1) div 2)")})
    marked = centred.join(mask.withColumn("_m", F.lit(1)), ["image_id", "y", "x"], "left")
    return marked.select(*boxes.columns, F.coalesce("_m", F.lit(0)).alias("label"))


def mask_coverage(boxes: DataFrame, cells: DataFrame, in_mask: Column) -> DataFrame:
    return window_means(boxes, cells, {"coverage": in_mask.cast("double")})


def label_by_coverage(covered: DataFrame, positive: float = 0.70, negative: float = 0.05) -> DataFrame:
    """1 / 0 by coverage; windows in between are ambiguous and leave the training set."""
    label = F.when(F.col("coverage") >= positive, 1).when(F.col("coverage") <= negative, 0)
    return covered.withColumn("label", label).where(F.col("label").isNotNull())


def gated_windows(boxes: DataFrame, cells: DataFrame, gate: Column) -> DataFrame:
    """Windows that touch at least one gated cell; a cell that isn't in the map is gated."""
    hit = box_sums(boxes, cells, {"_hit": gate.cast("double")}, missing=1.0)
    return hit.where(F.col("_hit") > 0.5).select(*boxes.columns)


def cascade(scored_coarse: DataFrame, fine: DataFrame, combined: DataFrame, gate_at: float) -> DataFrame:
    """Coarse windows plus the fine windows that touch a cell the coarse map found suspicious.

    Cells no coarse window covered count as suspicious.
    """
    kept = gated_windows(fine, combined, F.coalesce(F.col("heat") >= gate_at, F.lit(True)))
    return scored_coarse.select(*fine.columns).unionByName(kept)
