"""Raster operators on dense `cells(image_id, y, x, ...)` tables.

Every window is partitioned by the image first, so one hash partitioning on `image_id`
serves a whole chain. An image's cells are bounded by its working size (`max_side` and
`cell_px`), so no image grows with the table.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelwarrant.functions.scalar import clip, reflected

KEYS = ("image_id",)


def by_image(df: DataFrame) -> DataFrame:
    """Hash-partition once on the image; the per-image windows and sums that follow need no shuffle."""
    return df.repartition("image_id")


def _row(keys: Sequence[str]):
    return Window.partitionBy(*keys, "y").orderBy("x")


def _col(keys: Sequence[str]):
    return Window.partitionBy(*keys, "x").orderBy("y")


def _both_axes(df: DataFrame, keys: Sequence[str], exprs: dict[str, Column], agg, radius: int) -> DataFrame:
    """Apply a range aggregate along x and then along y; results replace or add columns."""
    first = df.withColumns({f"_ax_{n}": agg(c).over(_row(keys).rangeBetween(-radius, radius)) for n, c in exprs.items()})
    second = first.withColumns(
        {n: agg(f"_ax_{n}").over(_col(keys).rangeBetween(-radius, radius)) for n in exprs}
    )
    return second.drop(*[f"_ax_{n}" for n in exprs])


PREFIX_FROM = 16  # radius above which running totals are cheaper than moving frames


def box_sum(df: DataFrame, exprs: dict[str, Column], radius: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sum over the (2r+1)^2 neighbourhood, clipped at the frame."""
    if radius <= PREFIX_FROM:
        return _both_axes(df, keys, exprs, F.sum, radius)
    out = df.withColumns({f"_ax_{n}": c for n, c in exprs.items()})
    for spec in (_row(keys), _col(keys)):
        upto = spec.rowsBetween(Window.unboundedPreceding, 0)
        whole = spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = out.withColumns(
            {f"_cu_{n}": F.sum(f"_ax_{n}").over(upto) for n in exprs}
            | {f"_to_{n}": F.sum(f"_ax_{n}").over(whole) for n in exprs}
        )
        out = out.withColumns(
            {
                f"_ax_{n}": F.coalesce(F.lead(f"_cu_{n}", radius).over(spec), F.col(f"_to_{n}"))
                - F.coalesce(F.lag(f"_cu_{n}", radius + 1).over(spec), F.lit(0.0))
                for n in exprs
            }
        ).drop(*[f"_cu_{n}" for n in exprs], *[f"_to_{n}" for n in exprs])
    return out.withColumns({n: F.col(f"_ax_{n}") for n in exprs}).drop(*[f"_ax_{n}" for n in exprs])


def box_mean(df: DataFrame, exprs: dict[str, Column], radius: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean over the neighbourhood, divided by the real number of cells."""
    if radius <= 0:
        return df.withColumns(exprs)
    summed = box_sum(df, exprs | {"_n_box": F.lit(1.0)}, radius, keys)
    return summed.withColumns({n: F.col(n) / F.col("_n_box") for n in exprs}).drop("_n_box")


def gaussian_taps(sigma: float, truncate: float = 3.0, half_up: bool = False) -> list[tuple[int, float]]:
    radius = int(truncate * sigma + 0.5) if half_up else max(1, round(truncate * sigma))
    raw = [math.exp(-(k * k) / (2.0 * sigma * sigma)) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [(k, w / total) for k, w in zip(range(-radius, radius + 1), raw)]


def _along(df: DataFrame, keys: Sequence[str], line: str, pos: str, make) -> DataFrame:
    """Pack each grid line into one array, let `make(array)` rebuild it, and unpack again.

    The array holds whole cell structs sorted by position, so no join is needed to bring the
    other columns back. A line is at most one image side long.
    """
    rest = [c for c in df.columns if c not in (*keys, line, pos)]
    packed = df.groupBy(*keys, line).agg(
        F.sort_array(F.collect_list(F.struct(pos, *rest))).alias("_line")
    )
    return packed.select(*keys, line, F.explode(make(F.col("_line"))).alias("_cell")).select(*keys, line, "_cell.*")


Taps = Sequence[tuple[int, float]]


# Of frames of one size, `v[image, y, x]`, and of one image that isn't a whole frame: y, x and v of its cells in rows.
Frames = Callable[[np.ndarray], np.ndarray]
Torn = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def on_frames(df: DataFrame, outputs: dict[str, tuple[str, Frames, Torn, bool]], keys: Sequence[str] = KEYS) -> DataFrame:
    """New columns from whole images: `outputs` maps a column to (input, function of whole frames, function of others, `strict`).

    An image's cells are packed to one row, Arrow batches of images are computed together where their frames have one size, and cells
    are unpacked again, so nothing is joined. A `strict` output is null where its function, given ones for nulls, finds any.
    """
    rest = [c for c in df.columns if c not in (*keys, "y", "x", *outputs)]
    sources = sorted({source for source, *_ in outputs.values()})
    many = T.StructType([T.StructField(name, T.ArrayType(T.DoubleType())) for name in outputs])

    @F.arrow_udf(many)
    def computed(y: pa.Array, x: pa.Array, *values: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(y.value_lengths().to_numpy())]).astype(np.int64)
        y, x = (c.flatten().to_numpy(zero_copy_only=False) for c in (y, x))
        flat = {n: c.flatten() for n, c in zip(sources, values)}
        gone = {n: c.is_null().to_numpy(zero_copy_only=False).astype(float) if c.null_count else None for n, c in flat.items()}
        flat = {n: c.to_numpy(zero_copy_only=False) for n, c in flat.items()}
        out, null = {n: np.empty(len(y)) for n in outputs}, {n: np.zeros(len(y), bool) for n in outputs}

        def put(at: np.ndarray, apply: Callable) -> None:
            for name, (source, frames, torn, strict) in outputs.items():
                out[name][at] = apply(frames, torn, flat[source][at])
                if strict and gone[source] is not None:
                    null[name][at] = apply(frames, torn, gone[source][at]) > 0

        for size in np.unique(np.diff(ends)):
            at = ends[:-1][np.diff(ends) == size][:, None] + np.arange(size)
            w, h = x[at].max(1) + 1, y[at].max(1) + 1
            step = np.maximum(w, 1)[:, None]
            whole = (w * h == size) & (y[at] == np.arange(size) // step).all(1) & (x[at] == np.arange(size) % step).all(1)
            for width in np.unique(w[whole]):
                own = at[whole & (w == width)]
                put(own, lambda frames, torn, v: frames(v.reshape(len(own), -1, int(width))).reshape(own.shape))
            for own in at[~whole]:
                put(own, lambda frames, torn, v: torn(y[own], x[own], v))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out[n], mask=null[n])) for n in outputs]
        return pa.StructArray.from_arrays(lists, names=list(outputs))

    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("y", "x", *rest))).alias("_cell"))
    double = lambda c: F.col(f"_cell.{c}").cast("array<double>")
    done = packed.withColumn("_out", computed("_cell.y", "_cell.x", *[double(c) for c in sources]))
    cells = done.select(*keys, F.explode(F.arrays_zip("_cell", *[F.col(f"_out.{n}").alias(n) for n in outputs])).alias("_at"))
    return cells.select(*keys, "_at._cell.*", *[F.col(f"_at.{n}").alias(n) for n in outputs])


def _swept(v: np.ndarray, taps: Taps, repeat_edge: bool) -> np.ndarray:
    n = v.shape[-1]
    period = 2 * n if repeat_edge else max(1, 2 * (n - 1))
    out = np.zeros_like(v)
    for k, w in taps:
        at = (np.arange(n) + k) % period
        out += w * v[..., np.where(at < n, at, period - at - (1 if repeat_edge else 0))]
    return out


def _lines(at: np.ndarray) -> list[np.ndarray]:
    """The places of each value of `at`, in order."""
    order = np.argsort(at, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(at[order])) + 1)


def convolve(
    df: DataFrame, outputs: dict[str, tuple[str, Taps]], keys: Sequence[str] = KEYS, repeat_edge: bool = False
) -> DataFrame:
    """Separable convolutions with mirrored edges: `outputs` maps a new column to (input, taps)."""
    return on_frames(df, {out: blurring(source, taps, repeat_edge) for out, (source, taps) in outputs.items()}, keys)


def blurring(source: str, taps: Taps, repeat_edge: bool = False) -> tuple[str, Frames, Torn, bool]:
    """A separable convolution for `on_frames`, along x and then along y; the cells of a torn line move together."""

    def frames(v: np.ndarray) -> np.ndarray:
        rows = _swept(v, taps, repeat_edge)
        return _swept(rows.swapaxes(-1, -2), taps, repeat_edge).swapaxes(-1, -2)

    def torn(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = v.copy()
        for line in (*_lines(y), *_lines(x)):
            out[line] = _swept(out[line], taps, repeat_edge)
        return out

    return source, frames, torn, True


def convolve_by(df: DataFrame, columns: Sequence[str], kernel: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Separable convolution of `columns` in place, mirrored at the edges, with a kernel (array of k, w) that the keys decide."""

    def make(line: Column) -> Column:
        n = F.size(line)
        total = lambda c, i: F.aggregate("_kernel", F.lit(0.0), lambda acc, t: acc + t["w"] * F.get(line, reflected(i + t["k"], n, False))[c])

        def cell(s: Column, i: Column) -> Column:
            for c in columns:
                s = s.withField(c, total(c, i))
            return s

        return F.transform(line, cell)

    def axis(rows: DataFrame, line: str, pos: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, line, pos)]
        packed = rows.groupBy(*keys, line).agg(F.sort_array(F.collect_list(F.struct(pos, *rest))).alias("_line")).withColumn("_kernel", kernel)
        return packed.select(*keys, line, F.explode(make(F.col("_line"))).alias("_cell")).select(*keys, line, "_cell.*")

    return axis(axis(df, "y", "x"), "x", "y")


def gaussian_blur(df: DataFrame, columns: dict[str, str], sigma: float, keys: Sequence[str] = KEYS, **how) -> DataFrame:
    """Gaussian blur: radius 3 sigma and mirrored edges by default.

    `truncate=4, half_up=True, repeat_edge=True` is the variant the spectral features use.
    """
    repeat_edge = how.pop("repeat_edge", False)
    if sigma <= 0:
        return df.withColumns({o: F.col(s) for o, s in columns.items()})
    taps = gaussian_taps(sigma, **how)
    return convolve(df, {out: (src, taps) for out, src in columns.items()}, keys, repeat_edge)


def residual(df: DataFrame, column: str, out: str, sigma: float = 1.0, keys: Sequence[str] = KEYS, **how) -> DataFrame:
    """High-pass residual: the image minus its blurred self."""
    blurred = gaussian_blur(df, {"_blur": column}, sigma, keys, **how)
    return blurred.withColumn(out, F.col(column) - F.col("_blur")).drop("_blur")


def local_variance(df: DataFrame, column: str, radius: int, keys: Sequence[str] = KEYS) -> DataFrame:
    c = F.col(column)
    means = box_mean(df, {"_m": c, "_mm": c * c}, radius, keys)
    return means.withColumn("local_var", F.greatest(F.lit(0.0), F.col("_mm") - F.col("_m") * F.col("_m"))).drop("_m", "_mm")


def guided_filter(
    df: DataFrame, target: str, guide: str, radius: int, eps: float = 1e-3, out: str = "smooth", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Edge-preserving smoothing of `target` along the edges of `guide`; six box means in two passes."""
    if radius <= 0:
        return df.withColumn(out, F.col(target))
    p, g = F.col(target), F.col(guide)
    means = box_mean(df, {"_mg": g, "_mp": p, "_gg": g * g, "_gp": g * p}, radius, keys)
    var = F.greatest(F.lit(0.0), F.col("_gg") - F.col("_mg") * F.col("_mg"))
    slope = (F.col("_gp") - F.col("_mg") * F.col("_mp")) / (var + eps)
    lines = means.withColumn("_a", slope).withColumn("_b", F.col("_mp") - F.col("_a") * F.col("_mg"))
    lines = lines.drop("_mg", "_mp", "_gg", "_gp")
    smooth = box_mean(lines, {"_ma": F.col("_a"), "_mb": F.col("_b")}, radius, keys)
    return smooth.withColumn(out, F.col("_ma") * g + F.col("_mb")).drop("_a", "_b", "_ma", "_mb")


def smooth_heatmap(
    df: DataFrame,
    heat: str = "heat",
    guide: str | None = None,
    method: str = "guided",
    radius: int = 8,
    eps: float = 1e-3,
    out: str = "smooth",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Smooth a map that may have uncovered (NULL) cells.

    NULLs are filled with the image mean, filtered, clipped to [0, 1], and restored.
    """
    filled = df.withColumn("_f", F.coalesce(F.col(heat), F.avg(heat).over(Window.partitionBy(*keys))))
    if method == "none" or radius <= 0:
        done = filled.withColumn("_s", F.col("_f"))
    elif method == "box" or (method == "guided" and guide is None):
        done = box_mean(filled, {"_s": F.col("_f")}, radius, keys)
    elif method == "gaussian":
        done = gaussian_blur(filled, {"_s": "_f"}, max(1.0, radius / 3.0), keys)
    elif method == "guided":
        done = guided_filter(filled, "_f", guide, radius, eps, "_s", keys)
    else:
        raise ValueError(f"unknown smoothing method {method!r}")
    return done.withColumn(out, F.when(F.col(heat).isNotNull(), clip(F.col("_s")))).drop("_f", "_s")


# --- masks --------------------------------------------------------------------------------


def dilate(df: DataFrame, mask: str, radius: int, out: str, keys: Sequence[str] = KEYS) -> DataFrame:
    if radius <= 0:
        return df.withColumn(out, F.col(mask))
    return _both_axes(df, keys, {out: F.col(mask)}, F.max, radius)


def erode(df: DataFrame, mask: str, radius: int, out: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Dual of `dilate`: what lies outside the frame counts as foreground."""
    if radius <= 0:
        return df.withColumn(out, F.col(mask))
    return _both_axes(df, keys, {out: F.col(mask)}, F.min, radius)


def close(df: DataFrame, mask: str, radius: int, out: str, keys: Sequence[str] = KEYS) -> DataFrame:
    grown = dilate(df, mask, radius, "_grown", keys)
    return erode(grown, "_grown", radius, out, keys).drop("_grown")


def rim(df: DataFrame, mask: str, out: str = "rim", keys: Sequence[str] = KEYS) -> DataFrame:
    inner = erode(df, mask, 1, "_inner", keys)
    return inner.withColumn(out, F.col(mask) & ~F.col("_inner")).drop("_inner")


def ring(df: DataFrame, mask: str, radius: int, out: str = "ring", keys: Sequence[str] = KEYS) -> DataFrame:
    outer = dilate(df, mask, radius, "_outer", keys)
    return outer.withColumn(out, F.col("_outer") & ~F.col(mask)).drop("_outer")


def perimeter(df: DataFrame, mask: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Exposed 4-neighbour edges of each cell of the mask, the frame edge included, as `exposed`."""
    near = lambda fn, spec: F.coalesce(fn(F.col(mask).cast("int")).over(spec), F.lit(0))
    touching = near(F.lag, _row(keys)) + near(F.lead, _row(keys)) + near(F.lag, _col(keys)) + near(F.lead, _col(keys))
    return df.withColumn("exposed", F.when(F.col(mask), 4 - touching).otherwise(0))


def gradient(df: DataFrame, column: str, out: str = "gradient", keys: Sequence[str] = KEYS) -> DataFrame:
    """Gradient magnitude: central differences, one-sided at the frame."""

    def slope(spec) -> Column:
        here, before, after = F.col(column), F.lag(column).over(spec), F.lead(column).over(spec)
        return (
            F.when(before.isNull() & after.isNull(), 0.0)
            .when(before.isNull(), after - here)
            .when(after.isNull(), here - before)
            .otherwise((after - before) / 2)
        )

    both = df.withColumns({"_gx": slope(_row(keys)), "_gy": slope(_col(keys))})
    return both.withColumn(out, F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))).drop("_gx", "_gy")


def straight_cells(df: DataFrame, mask: str, keys: Sequence[str] = KEYS, run: int = 5) -> DataFrame:
    """Per key: rim cells, and cells lying in axis-aligned runs of at least `run` cells."""
    on = df.where(F.col(mask)).select(*keys, "y", "x")

    def runs(line: str, pos: str) -> DataFrame:
        island = F.col(pos) - F.row_number().over(Window.partitionBy(*keys, line).orderBy(pos))
        return (
            on.withColumn("_i", island)
            .groupBy(*keys, line, "_i")
            .agg(F.count(F.lit(1)).alias("_len"))
            .groupBy(*keys)
            .agg(F.sum(F.when(F.col("_len") >= run, F.col("_len")).otherwise(0)).alias("_straight"), F.sum("_len").alias("_cells"))
        )

    both = runs("y", "x").unionByName(runs("x", "y"))
    return both.groupBy(*keys).agg(
        F.least(F.lit(1.0), F.sum("_straight") / F.sum("_cells")).alias("edge_straightness"),
        (F.sum("_cells") / 2).cast("long").alias("rim_cells"),
    )


# --- resampling ---------------------------------------------------------------------------


def resample_nearest(df: DataFrame, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> DataFrame:
    """Nearest-neighbour resample to another size; each cell names the target cells it fills."""

    def targets(at: Column, n_from: Column, n_to: Column) -> Column:
        first = F.ceil(at * n_to / n_from - 0.5)
        after = F.ceil((at + 1) * n_to / n_from - 0.5)
        return F.when(after > first, F.sequence(first.cast("int"), (after - 1).cast("int")))

    rest = [c for c in df.columns if c not in ("y", "x")]
    rows = df.select(*rest, "x", F.explode(targets(F.col("y"), from_h, to_h)).alias("y"))
    return rows.select(*rest, "y", F.explode(targets(F.col("x"), from_w, to_w)).alias("x"))


def block_mean(df: DataFrame, values: Sequence[str], block: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean over `block` x `block` cells."""
    return df.groupBy(*keys, F.expr(f"int(y div {block})").alias("y"), F.expr(f"int(x div {block})").alias("x")).agg(
        *[F.avg(v).alias(v) for v in values]
    )


def resample_bilinear(df: DataFrame, columns: Sequence[str], to_w: Column, to_h: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Separable bilinear resample, widened on the way down (anti-aliased)."""

    def one_axis(n_out: Column, pos: str):
        def make(line: Column) -> Column:
            n_in = F.size(line)
            step = n_in / n_out
            spread = F.greatest(step, F.lit(1.0))

            def cell(i: Column) -> Column:
                centre = (i + 0.5) * step
                low = F.greatest(F.lit(0), F.floor(centre - spread + 0.5).cast("int"))
                high = F.least(n_in, F.floor(centre + spread + 0.5).cast("int"))
                taps = F.transform(
                    F.sequence(low, high - 1),
                    lambda j: F.struct(j.alias("j"), F.greatest(F.lit(0.0), 1 - F.abs((j + 0.5 - centre) / spread)).alias("w")),
                )
                weight = F.aggregate(taps, F.lit(0.0), lambda a, t: a + t["w"])
                value = lambda c: F.aggregate(taps, F.lit(0.0), lambda a, t: a + t["w"] * F.get(line, t["j"])[c]) / weight
                return F.struct(i.alias(pos), *[value(c).alias(c) for c in columns])

            return F.transform(F.sequence(F.lit(0), n_out - 1), cell)

        return make

    slim = df.select(*keys, "y", "x", *columns)
    rows = _along(slim, keys, "y", "x", one_axis(to_w, "x"))
    return _along(rows, keys, "x", "y", one_axis(to_h, "y"))


def normalise_channels(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """(value - mean) / std per channel."""
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in stats.items()})
