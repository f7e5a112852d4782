"""Degradation severities: which transform steps a name stands for, and random copy plans."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelwarrant.session import small

# Severity name -> transform steps in order.
SEVERITIES: dict[str, list[tuple[str, float]]] = {
    "clean": [],
    "jpeg_q90": [("jpeg", 90)],
    "jpeg_q70": [("jpeg", 70)],
    "jpeg_q50": [("jpeg", 50)],
    "jpeg_q30": [("jpeg", 30)],
    "blur_s0.5": [("blur", 0.5)],
    "blur_s1.0": [("blur", 1.0)],
    "blur_s2.0": [("blur", 2.0)],
    "resize_0.5x": [("resize", 0.5)],
    "resize_0.25x": [("resize", 0.25)],
    "noise_s0.02": [("noise", 0.02)],
    "noise_s0.05": [("noise", 0.05)],
    "noise_s0.10": [("noise", 0.10)],
    "color_jitter_20pct": [("color_jitter", 0.20)],
    "center_crop_80pct": [("center_crop", 0.80)],
    "compound_moderate": [("resize", 0.5), ("jpeg", 70), ("color_jitter", 0.20)],
    "compound_severe": [("resize", 0.25), ("jpeg", 30), ("blur", 1.0), ("noise", 0.05)],
}

# The second list, used when an analysed image is degraded.
CONDITIONS: dict[str, list[tuple[str, float]]] = {
    "clean": [],
    "jpeg_q90": [("jpeg", 90)],
    "jpeg_q60": [("jpeg", 60)],
    "jpeg_q30": [("jpeg", 30)],
    "blur_s0.5": [("blur", 0.5)],
    "blur_s1.0": [("blur", 1.0)],
    "blur_s2.0": [("blur", 2.0)],
    "downscale_0.5": [("downscale", 0.5)],
    "downscale_0.25": [("downscale", 0.25)],
    "noise_s0.02": [("noise", 0.02)],
    "noise_s0.05": [("noise", 0.05)],
    "crop_0.9": [("crop", 0.9)],
    "crop_0.8": [("crop", 0.8)],
    "saturate_1.5": [("saturate", 1.5)],
}

# Magnitudes and probabilities of the random copies.
RESIZE_SCALES = (0.5, 0.25)
BLUR_SIGMAS = (0.5, 1.0, 2.0)
JPEG_QUALITIES = (90, 70, 50, 30)
NOISE_SIGMAS = (0.02, 0.05, 0.10)
JITTER_DELTA = 0.20
CROP_FRACTION = 0.80
MIN_SIDE_AFTER_RESIZE = 16
PROBABILITIES = {"resize": 0.4, "center_crop": 0.3, "blur": 0.4, "color_jitter": 0.4, "noise": 0.4, "jpeg": 0.5}


def severity_table(spark: SparkSession, levels: dict[str, list[tuple[str, float]]] = SEVERITIES) -> DataFrame:
    """`severities(severity, step, op, param)`: a few dozen fixed rows; the identity has step 0."""
    rows = []
    for name, steps in levels.items():
        rows.append((name, 0, "identity", None))
        rows += [(name, i, op, float(param)) for i, (op, param) in enumerate(steps, 1)]
    return spark.createDataFrame(rows, "severity string, step int, op string, param double")


def lookup(requests: DataFrame, table: DataFrame, name: str = "severity") -> DataFrame:
    """Ordered steps per request; an unknown name keeps its row with `known = false`."""
    known = table.withColumn("known", F.lit(True))
    return requests.join(small(known), name, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def require_known(requests: DataFrame, table: DataFrame, name: str = "severity") -> None:
    unknown = requests.select(name).distinct().join(small(table), name, "left_anti").limit(20).collect()
    if unknown:
        raise ValueError(f"unknown severities: {sorted(r[0] for r in unknown)}")


def across_severities(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every row under every severity, made row by row (no join)."""
    return df.select("*", F.explode(F.array(*[F.lit(n) for n in names])).alias("severity"))


def parse_severity(name: Column) -> Column:
    """Operation and number inside a severity name."""
    return F.struct(
        F.regexp_extract(name, r"^([a-z_]+?)_?[sq]?[0-9]", 1).alias("op"),
        F.expr("try_cast(regexp_extract(severity, '([0-9]+[.]?[0-9]*)', 1) as double)").alias("param"),
    )


def _array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def allowed_magnitudes(min_side: Column) -> dict[str, Column]:
    """Magnitudes an image of this size survives."""
    sigma_limit = F.greatest(F.lit(0.5), min_side / F.lit(112.0))
    quality_floor = F.when(min_side < 64, 70.0).otherwise(0.0)
    return {
        "resize_scales": F.filter(_array(RESIZE_SCALES), lambda s: min_side * s >= MIN_SIDE_AFTER_RESIZE),
        "blur_sigmas": F.filter(_array(BLUR_SIGMAS), lambda s: s <= sigma_limit),
        "jpeg_qualities": F.filter(_array(JPEG_QUALITIES), lambda q: q >= quality_floor),
    }


def describe_plan(min_side: Column) -> Column:
    """Readable effective plan for an image size."""
    parts = []
    for name, values in allowed_magnitudes(min_side).items():
        text = F.array_join(F.transform(values, lambda v: F.format_string("%.2f", v)), ",")
        parts.append(F.concat(F.lit(f"{name}="), F.when(F.size(values) == 0, "DISABLED").otherwise(text)))
    return F.concat_ws(" ", *parts)


def hashed_uniform(*ids: str, seed: int = 0) -> Callable[[int], Column]:
    """Independent uniform draws keyed by row identity and a salt."""
    return lambda salt: F.pmod(F.xxhash64(*ids, F.lit(salt), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def random_plan(df: DataFrame, min_side: Column, uniform: Callable[[int], Column]) -> DataFrame:
    """The steps a random copy goes through, as an ordered array of (op, param)."""
    allowed = allowed_magnitudes(min_side)

    def choose(values: Column, salt: int) -> Column:
        at = F.least(F.floor(uniform(salt) * F.size(values)).cast("int"), F.size(values) - 1)
        return F.get(values, at)

    def step(i: int, op: str, values: Column) -> Column:
        taken = (F.size(values) > 0) & (uniform(2 * i) < PROBABILITIES[op])
        return F.when(taken, F.struct(F.lit(op).alias("op"), choose(values, 2 * i + 1).alias("param")))

    plan = F.array(
        step(0, "resize", allowed["resize_scales"]),
        step(1, "center_crop", _array([CROP_FRACTION])),
        step(2, "blur", allowed["blur_sigmas"]),
        step(3, "color_jitter", _array([JITTER_DELTA])),
        step(4, "noise", _array(NOISE_SIGMAS)),
        step(5, "jpeg", allowed["jpeg_qualities"]),
    )
    return df.withColumn("plan", F.filter(plan, lambda s: s.isNotNull()))
