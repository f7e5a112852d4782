"""Small column functions: clipping, logit, interpolation, padding indices, names, boxes."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    bounded = F.greatest(F.lit(low), F.least(F.lit(high), c))
    return F.when(c.isNotNull(), bounded)


def logit(p: Column) -> Column:
    safe = clip(p, 1e-6, 1.0 - 1e-6)
    return F.ln(safe / (1.0 - safe))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(z, -60.0, 60.0)))


def interpolate(value: Column, knots: Column) -> Column:
    """Piecewise-linear interpolation over an array of (x, y) sorted by x, flat outside."""
    first, last = F.element_at(knots, 1), F.element_at(knots, -1)
    below = F.element_at(F.filter(knots, lambda k: k["x"] <= value), -1)
    above = F.element_at(F.filter(knots, lambda k: k["x"] > value), 1)
    inner = below["y"] + (above["y"] - below["y"]) * F.try_divide(value - below["x"], above["x"] - below["x"])
    return (
        F.when(value.isNull(), None)
        .when(value < first["x"], first["y"])
        .when(value >= last["x"], last["y"])
        .otherwise(inner)
    )


def blend(*terms: tuple[Column, Column | float]) -> Column:
    """Weighted mean of (value, weight) pairs in [0, 1]; 0.5 without any weight."""
    top, total = F.lit(0.0), F.lit(0.0)
    for value, weight in terms:
        w = weight if isinstance(weight, Column) else F.lit(float(weight))
        used = F.when(value.isNotNull() & (w > 0), w).otherwise(0.0)
        top = top + F.coalesce(value, F.lit(0.0)) * used
        total = total + used
    return F.when(total > 0, clip(F.try_divide(top, total))).otherwise(F.lit(0.5))


def present(*texts: Column) -> Column:
    """The non-NULL texts in order (no text holds a line break)."""
    joined = F.concat_ws("\n", *texts)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, "\n"))


def squash(value: Column, scale: float) -> Column:
    """A signed contrast mapped to [0, 1], 0 landing on 0.5."""
    return 0.5 * (1.0 + F.tanh(value / max(scale, 1e-6)))


def contrast(inside: Column, outside: Column) -> Column:
    """Signed scale-free difference in [-1, 1]; 0 when both are (nearly) nothing."""
    size = F.abs(inside) + F.abs(outside)
    return F.when(size < 1e-8, 0.0).otherwise(clip(F.try_divide(inside - outside, size), -1.0, 1.0))


def l2_normalised(values: Column) -> Column:
    doubles = F.transform(values, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(doubles, lambda v: v / F.greatest(norm, F.lit(1e-12)))


def normalise_label(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), "[^a-z0-9]", "")


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r".(\.[^.]*)$", 1))


def parent(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def fine_minus_coarse(profile: Column) -> Column:
    """Mean at the smallest scale minus mean at the largest; 0 with fewer than two usable scales."""
    keys = F.map_keys(profile)
    lead = F.try_element_at(profile, F.array_min(keys)) - F.try_element_at(profile, F.array_max(keys))
    return F.when(F.size(keys) < 2, 0.0).otherwise(F.coalesce(lead, F.lit(0.0)))


def padded_box(box: Column, pad: int, width: Column, height: Column) -> Column:
    return F.struct(
        F.greatest(F.lit(0), box["x0"] - pad).alias("x0"),
        F.greatest(F.lit(0), box["y0"] - pad).alias("y0"),
        F.least(width, box["x1"] + pad).alias("x1"),
        F.least(height, box["y1"] + pad).alias("y1"),
    )


def scaled_box(box: Column, factor: Column) -> Column:
    """A box in the coordinates of the original image."""
    return F.array(*[F.bround(box[n] * factor).cast("int") for n in ("x0", "y0", "x1", "y1")])


def box_iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda q: (q["x1"] - q["x0"]) * (q["y1"] - q["y0"])
    return F.coalesce(F.try_divide((w * h).cast("double"), area(a) + area(b) - w * h), F.lit(0.0))


def reflected(i: Column, n: Column, repeat_edge: bool = False) -> Column:
    """Index inside [0, n) of a position beyond the edge, mirrored with or without repeating the edge."""
    if repeat_edge:
        m = F.pmod(i, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)
    period = F.greatest(F.lit(1), 2 * (n - 1))
    m = F.pmod(i, period)
    return F.when(m < n, m).otherwise(period - m)


def hann(offset: Column, length: Column) -> Column:
    """Raised-cosine weight of a position inside a window, never zero."""
    bell = 0.5 - 0.5 * F.cos(2 * F.pi() * (offset + 1) / (length + 1)) + 1e-3
    return F.when(length == 1, 1.0).otherwise(bell)
