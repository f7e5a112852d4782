"""Evidence scorers over regions, as column pipelines.

Each scorer is a function of Column expressions returning one struct `(probability,
confidence, evidence, kind)`; it reads region descriptors and the region report. A new
scorer is one more entry of the mapping that `run_scorers` takes.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelwarrant.functions.scalar import blend, clip, present, squash
from pixelwarrant.operators.routing import percent

# Confidence ceilings of the two limited scorers.
FACE_MAX_CONFIDENCE = 0.55
FALLBACK_MAX_CONFIDENCE = 0.35


def result(probability: Column, confidence: Column, evidence: Column, kind: Column | None = None) -> Column:
    return F.struct(
        clip(probability).alias("probability"),
        clip(confidence).alias("confidence"),
        evidence.alias("evidence"),
        (F.lit(None).cast("string") if kind is None else kind).alias("kind"),
    )


def _unmeasured() -> Column:
    return result(F.col("mean_score"), F.lit(0.15), F.array(F.lit("too few cells for a forensic comparison")))


def _traces(nothing: str, *pairs: tuple[Column, Column]) -> tuple[Column, Column]:
    """Texts of the conditions that hold (or `nothing`), and whether none holds."""
    some = pairs[0][0]
    for cond, _ in pairs[1:]:
        some = some | cond
    return present(*[F.when(c, t) for c, t in pairs], F.when(~some, F.lit(nothing))), ~some


def prepared(regions: DataFrame) -> DataFrame:
    """Add the quantities that several scorers or texts read, each as one column."""
    noise, detail = F.col("noise_contrast"), F.col("high_freq_contrast")
    zero = F.lit(0.0)
    first = regions.withColumns(
        {
            # How much block structure the surroundings show at all.
            "_weight": clip((F.greatest("jpeg_grid_inside", "jpeg_grid_outside") - 1.0) / 0.15),
            "_smooth_vote": squash(-noise, 0.25),
            "_detail_vote": squash(-detail, 0.30),
            "_coverage": clip(F.col("area_frac") / 0.55),
            "_agreement": clip(1.0 - F.col("scale_disagreement") / 0.15),
            "_uniformity": clip(1.0 - F.col("heat_std") / 0.20),
        }
    )
    # Does the discontinuity point at a generator, or at a conventional edit?
    history = F.col("_weight") * (F.abs(F.col("jpeg_grid_contrast")) + F.greatest(zero, F.col("ela_contrast")))
    second = first.withColumns(
        {
            "_ai_lean": F.greatest(zero, -noise) + F.greatest(zero, -detail),
            "_plain_lean": F.greatest(zero, noise) + history,
            "_lean": F.abs(noise) + F.greatest(zero, -detail) + history,
        }
    )
    both = F.col("_ai_lean") + F.col("_plain_lean")
    return second.withColumn("_ai_share", F.when(both > 1e-6, F.try_divide(F.col("_ai_lean"), both)).otherwise(0.5))


# The weights and scales inside the five scorers below.


def inpainting() -> Column:
    noise, detail, lattice = F.col("noise_contrast"), F.col("high_freq_contrast"), F.col("jpeg_grid_contrast")
    weight, sharpness = F.col("_weight"), F.col("boundary_sharpness")
    smooth_vote, detail_vote = F.col("_smooth_vote"), F.col("_detail_vote")
    probability = blend(
        (smooth_vote, 1.0),
        (detail_vote, 0.8),
        (squash(F.abs(lattice), 0.20), weight * 0.8),
        (0.5 + 0.5 * clip(sharpness / 0.04), 0.5),
        (F.col("mean_score"), 1.2),
        (F.col("crop_score"), 0.8),
    )
    both_vote = (F.abs(smooth_vote - 0.5) > 0.02) & (F.abs(detail_vote - 0.5) > 0.02)
    same_side = F.abs(F.signum(smooth_vote - 0.5) + F.signum(detail_vote - 0.5)) / 2
    confidence = F.least(
        F.lit(0.9),
        0.25 + 0.35 * F.when(both_vote, same_side).otherwise(0.0) + 0.20 * weight + 0.20 * F.least(F.lit(1.0), F.col("area_frac") / 0.05),
    )
    found, none = _traces(
        "no break found at the rim",
        (noise < -0.08, F.concat(F.lit("noise floor lower than around by "), percent(-noise))),
        (noise > 0.08, F.concat(F.lit("noise floor higher than around by "), percent(noise))),
        (detail < -0.08, F.concat(F.lit("fine detail below the ring by "), percent(-detail))),
        ((weight > 0.2) & (F.abs(lattice) > 0.08), F.lit("block lattice breaks at the rim")),
        (sharpness > 0.04, F.lit("map falls off sharply at the rim")),
    )
    return _measured(probability, confidence, found, none, 0.3)


def _measured(probability: Column, confidence: Column, found: Column, none: Column, bare: float, kind: Column | None = None) -> Column:
    """The result where the report is valid; with no trace found, confidence is held at `bare`."""
    held = F.least(confidence, F.when(none, bare).otherwise(1.0))
    return F.when(F.col("valid"), result(probability, held, found, kind)).otherwise(_unmeasured())


def compositing() -> Column:
    noise, lattice, ela, corr = (F.col(f"{n}_contrast") for n in ("noise", "jpeg_grid", "ela", "channel_corr"))
    weight, straight, share, lean = F.col("_weight"), F.col("edge_straightness"), F.col("_ai_share"), F.col("_lean")
    probability = blend(
        (squash(F.abs(noise), 0.25), 1.0),
        (squash(F.abs(lattice), 0.20), weight * 1.2),
        (squash(ela, 0.25), weight * 1.0),
        (squash(F.abs(corr), 0.30), 0.6),
        (clip(0.5 + straight * 0.5), 0.8),
        (F.col("mean_score"), 0.8),
    )
    confidence = F.least(
        F.lit(0.85), 0.20 + 0.30 * weight + 0.25 * F.least(F.lit(1.0), F.abs(noise) / 0.25) + 0.15 * straight
    )
    found, none = _traces(
        "no trace of compositing at the rim",
        (F.abs(noise) > 0.10, F.concat(F.lit("noise floor differs by "), percent(F.abs(noise)))),
        ((weight > 0.2) & (F.abs(lattice) > 0.08), F.lit("block lattice differs across the rim")),
        ((weight > 0.2) & (ela > 0.10), F.concat(F.lit("error level higher inside by "), percent(ela))),
        (straight > 0.35, F.concat(F.lit("straight rim share "), percent(straight))),
        (F.abs(corr) > 0.15, F.concat(F.lit("channel correlation differs by "), percent(F.abs(corr)))),
        ((lean > 0.15) & (share < 0.35), F.lit("reads as a conventional edit")),
        ((lean > 0.15) & (share > 0.65), F.lit("reads as a generative edit")),
    )
    kind = F.when(share > 0.65, "generative").when(share < 0.35, "conventional").otherwise("ambiguous")
    return _measured(probability, confidence, found, none, 0.25, kind)


def synthesis() -> Column:
    whole, mean = F.col("whole_image_score"), F.col("mean_score")
    coverage, agreement, uniformity = F.col("_coverage"), F.col("_agreement"), F.col("_uniformity")
    probability = blend((whole, 2.0), (mean, 1.0), (whole, coverage), (0.5 + agreement * (mean - 0.5), 0.6))
    confidence = F.least(F.lit(0.95), 0.30 + 0.30 * coverage + 0.25 * agreement + 0.15 * uniformity)
    found = present(
        F.when(F.col("area_frac") > 0.4, F.concat(F.lit("covers "), percent(F.col("area_frac")))),
        F.when(agreement > 0.6, F.lit("holds at every window scale")),
        F.when(uniformity > 0.6, F.lit("flat likelihood across the region")),
        F.concat(F.lit("whole-image score "), percent(whole)),
    )
    return result(probability, confidence, found)


def face_edit() -> Column:
    """Reads the report over region and face box (`face_` columns)."""
    valid = F.coalesce(F.col("face_valid"), F.lit(False))
    noise, detail = F.col("face_noise_contrast"), F.col("face_high_freq_contrast")
    asymmetry = F.col("eye_line_asymmetry")
    probability = blend(
        (F.col("mean_score"), 1.0),
        (F.col("face_crop_score"), 1.2),
        (squash(-noise, 0.25), F.when(valid, 1.0)),
        (squash(-detail, 0.30), F.when(valid, 0.8)),
        (clip(0.5 + asymmetry), F.when(asymmetry.isNotNull(), 0.5)),
    )
    confidence = F.least(
        F.lit(FACE_MAX_CONFIDENCE),
        0.20 + F.when(valid, 0.25).otherwise(0.0) + 0.15 * F.least(F.lit(1.0), F.col("area_frac") / 0.03),
    )
    found = present(
        F.lit("general check of a face region, not a face-swap model"),
        F.when(valid & (F.abs(noise) > 0.10), F.concat(F.lit("noise floor differs from the surround by "), percent(F.abs(noise)))),
        F.when(valid & (detail < -0.10), F.concat(F.lit("less fine detail than the surround by "), percent(-detail))),
        F.when(~valid, F.lit("too few cells for a forensic comparison")),
        F.when(asymmetry > 0.12, F.concat(F.lit("halves differ in noise by "), percent(asymmetry))),
        F.concat(F.lit("face crop score "), percent(F.col("face_crop_score"))),
    )
    return result(probability, confidence, found)


def fallback() -> Column:
    spread, support, size = F.col("scale_disagreement"), F.col("support"), F.col("area_frac")
    probability = blend((F.col("mean_score"), 1.0), (F.col("crop_score"), 1.0))
    confidence = F.least(
        F.lit(FALLBACK_MAX_CONFIDENCE), 0.10 + 0.10 * F.least(F.lit(1.0), size / 0.05) + 0.10 * clip(1.0 - spread / 0.2)
    )
    found = present(
        F.concat(F.lit("flagged by the map, mean "), percent(F.col("mean_score")), F.lit(", peak "), percent(F.col("max_score"))),
        F.concat(F.lit("crop score "), percent(F.col("crop_score"))),
        F.when(spread > 0.15, F.concat(F.lit("window scales disagree by "), percent(spread))),
        F.when(support < 0.4, F.concat(F.lit("thin window support "), percent(support))),
        F.when(size < 0.01, F.lit("too small for reliable contrasts")),
    )
    return result(probability, confidence, found)


SCORERS: dict[str, Callable[[], Column]] = {
    "inpainting": inpainting,
    "synthesis": synthesis,
    "face_edit": face_edit,
    "compositing": compositing,
    "fallback": fallback,
}


def unknown_scorers(names: list[str]) -> list[str]:
    return sorted(set(names) - set(SCORERS))


def run_scorers(regions: DataFrame, names: str = "scorers", scorers: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """One row per (region, scorer to run) with its result; an unregistered name raises when met.

    Each scorer's result is its own column, evaluated once per region and only where asked
    for; the results are then unpacked into rows.
    """
    scorers = scorers or SCORERS
    asked = lambda name: F.array_contains(F.col(names), name)
    strange = F.array_except(names, F.array(*[F.lit(n) for n in scorers]))
    checked = regions.withColumn(
        names,
        F.when(F.size(strange) > 0, F.raise_error(F.concat(F.lit("unknown scorer "), F.array_join(strange, ", ")))).otherwise(F.col(names)),
    )
    scored = prepared(checked).withColumns({f"_r_{n}": F.when(asked(n), scorer()) for n, scorer in scorers.items()})
    packed = F.array(*[F.struct(F.lit(n).alias("specialist"), F.col(f"_r_{n}").alias("result")) for n in scorers])
    rows = scored.select(*regions.columns, F.explode(packed).alias("_r")).where(F.col("_r.result").isNotNull())
    return rows.select(*regions.columns, "_r.specialist", "_r.result")
