"""Which evidence scorer looks at which region: readable rules over region descriptors."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelwarrant.functions.scalar import fine_minus_coarse, present


@dataclass(frozen=True)
class Rules:
    """Thresholds of the router (fixed values as defaults)."""

    whole_image_frac: float = 0.55
    scale_agreement_max: float = 0.12
    sharp_boundary: float = 0.030
    fine_scale_margin: float = 0.06
    rectangular_fill: float = 0.88
    weak_score: float = 0.60
    min_support: float = 0.35
    min_area_frac: float = 0.008
    unstable_scales: float = 0.22


def percent(c: Column) -> Column:
    """A share as whole percent text."""
    return F.concat(F.round(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def with_lead(regions: DataFrame) -> DataFrame:
    return regions.withColumn("fine_lead", fine_minus_coarse(F.col("scale_profile")))


def with_route(regions: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Add `fine_lead`, `weak` and `route`."""
    rules = rules or Rules()
    staged = with_lead(regions).withColumn("weak", weak_reasons(rules))
    return staged.withColumn("route", route(rules))


def weak_reasons(rules: Rules = Rules()) -> Column:
    """Why a region's evidence is too weak or unstable; an empty array when it is not.

    Scale disagreement that the fine scale's lead explains is not held against a region.
    """
    unexplained = F.col("scale_disagreement") - F.greatest(F.lit(0.0), F.col("fine_lead"))
    return present(
        F.when(F.col("mean_score") < rules.weak_score, F.concat(F.lit("mean score only "), percent(F.col("mean_score")))),
        F.when(F.col("support") < rules.min_support, F.concat(F.lit("window support only "), percent(F.col("support")))),
        F.when(F.col("area_frac") < rules.min_area_frac, F.concat(F.lit("area only "), percent(F.col("area_frac")))),
        F.when(
            unexplained > rules.unstable_scales,
            F.concat(F.lit("unexplained scale spread "), percent(unexplained)),
        ),
    )


def route(rules: Rules = Rules()) -> Column:
    """Primary scorer, alternates and reason, by the first rule that holds.

    Reads the region descriptors, `fine_lead`, `weak`, and `face_overlap` (NULL without a face).
    """
    sharp = F.col("boundary_sharpness") >= rules.sharp_boundary
    weak = F.col("weak")

    def decision(primary: str, alternates: list[str], reason: Column) -> Column:
        return F.struct(
            F.lit(primary).alias("primary"),
            F.array(*[F.lit(a) for a in alternates]).cast("array<string>").alias("alternates"),
            reason.alias("reason"),
        )

    return (
        F.when(
            F.col("face_overlap").isNotNull(),
            decision("face_edit", ["inpainting"], F.concat(F.lit("face box covers "), percent(F.col("face_overlap")))),
        )
        .when(
            (F.col("area_frac") >= rules.whole_image_frac) & (F.col("scale_disagreement") <= rules.scale_agreement_max),
            decision("synthesis", [], F.concat(F.lit("scales agree over "), percent(F.col("area_frac")), F.lit(" of the frame"))),
        )
        .when(F.size(weak) > 0, decision("fallback", [], F.array_join(weak, "; ")))
        .when(
            (F.col("fine_lead") >= rules.fine_scale_margin) & sharp,
            decision("inpainting", ["compositing"], F.concat(F.lit("local evidence, fine scale leads by "), percent(F.col("fine_lead")))),
        )
        .when(
            F.col("fill_ratio") >= rules.rectangular_fill,
            decision("compositing", ["inpainting"], F.concat(F.lit("box shape, fills "), percent(F.col("fill_ratio")))),
        )
        .when(sharp, decision("compositing", ["inpainting"], F.lit("sharp rim without fine-scale lead")))
        .otherwise(decision("inpainting", ["compositing"], F.lit("no distinguishing geometry")))
    )


def names_to_run(alternate_min_area: float = 0.02) -> Column:
    """The primary scorer, and the alternates for regions that are large enough."""
    extra = F.when(F.col("area_frac") >= alternate_min_area, F.col("route.alternates")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.col("route.primary")), extra))
