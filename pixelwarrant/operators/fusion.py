"""From scorer results to region findings, and from findings to one verdict per image."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelwarrant.functions.scalar import clip
from pixelwarrant.operators.regions import REGION
from pixelwarrant.operators.routing import percent

# Fixed value: confidence ceiling of an uncalibrated map.
UNCALIBRATED_CAP = 0.60


# The shares and scales inside `map_confidence`, the shrinkage and the verdict confidence below.


def map_confidence(high: float = 0.75) -> Column:
    """How far the map itself backs a region: strength, window support, scale stability."""
    strength = clip((F.col("mean_score") - high) / max(1e-6, 1.0 - high))
    support = clip(F.col("support") / 0.6)
    stability = clip(1.0 - F.col("scale_disagreement") / 0.25)
    return clip(0.35 * strength + 0.35 * support + 0.30 * stability)


def finding_label(primary: Column, kind: Column) -> Column:
    return (
        F.when(primary == "synthesis", "generated_content")
        .when(primary == "face_edit", "face_region_edit_evidence")
        .when(kind == "conventional", "conventional_manipulation")
        .when(primary == "fallback", "uncharacterised_suspicion")
        .otherwise("generative_edit")
    )


def fuse_regions(results: DataFrame, high: float = 0.75) -> DataFrame:
    """One finding per region: weighted consensus, shrunk to the map, capped by the map's support.

    `results` has one row per (region, scorer) with the region's descriptors.
    """
    p, c = F.col("result.probability"), F.col("result.confidence")
    is_primary = F.col("specialist") == F.col("route.primary")
    order = F.when(is_primary, 0).otherwise(1)
    firsts = [n for n in ("route", "bbox", "area_px", "area_frac", "mean_score", "max_score", "support", "scale_disagreement", "descriptors") if n in results.columns]
    grouped = results.groupBy(*REGION).agg(
        *[F.any_value(n).alias(n) for n in firsts],
        F.sum(p * c).alias("_pc"),
        F.sum(c).alias("_c"),
        F.max(c).alias("_top"),
        (F.max(p) - F.min(p)).alias("_spread"),
        F.max(F.when(is_primary, F.col("result.kind"))).alias("_kind"),
        F.sort_array(
            F.collect_list(F.struct(order.alias("o"), F.col("specialist"), F.col("result")))
        ).alias("specialists"),
    )
    known = F.col("_c") > 1e-6
    opinion = F.when(known, F.try_divide(F.col("_pc"), F.col("_c"))).otherwise(0.5)
    trust = F.when(known, clip(F.col("_top") * (1.0 - 0.5 * F.col("_spread")))).otherwise(0.0)
    staged = grouped.withColumns({"specialist_p": opinion, "specialist_conf": trust, "map_conf": map_confidence(high)})
    staged = staged.withColumn("shrunk", F.col("specialist_conf") * F.col("specialist_p") + (1.0 - F.col("specialist_conf")) * F.col("mean_score"))
    staged = staged.withColumn("probability", F.least(F.col("shrunk"), 0.5 + 0.5 * (0.35 + 0.65 * F.col("map_conf"))))
    capped = F.col("probability") < F.col("shrunk") - 1e-6
    texts = F.flatten(F.transform("specialists", lambda s: s["result"]["evidence"]))
    return staged.withColumns(
        {
            "confidence": clip(0.5 * F.col("map_conf") + 0.5 * F.col("specialist_conf")),
            "label": finding_label(F.col("route.primary"), F.col("_kind")),
            "evidence": F.when(
                capped, F.concat(texts, F.array(F.concat(F.lit("score capped at "), percent(F.col("probability")))))
            ).otherwise(texts),
        }
    ).drop("_pc", "_c", "_top", "_spread", "_kind")


def noisy_or(contribution: Column) -> Column:
    """1 - product of (1 - c) over the rows of a group."""
    return 1.0 - F.exp(F.sum(F.log1p(-clip(contribution, 0.0, 0.999))))


def image_evidence(findings: DataFrame, decide_at: float = 0.5) -> DataFrame:
    """Per image: combined local score, coverage, finding counts and the strongest finding."""
    excess = F.greatest(F.lit(0.0), F.col("probability") - decide_at) / max(1e-6, 1.0 - decide_at)
    contribution = excess * (0.4 + 0.6 * F.col("confidence"))
    strength = F.round(F.col("probability") * F.col("confidence"), 12)
    strongest = F.max_by(
        F.struct("region_id", "area_frac", "bbox", "route", F.slice("evidence", 1, 3).alias("evidence")),
        F.struct(strength, -F.col("region_id")),
    )
    return findings.groupBy("image_id").agg(
        (decide_at + (1.0 - decide_at) * noisy_or(contribution)).alias("local_score"),
        F.count(F.lit(1)).alias("n_findings"),
        F.count_if(F.col("route.primary") == "synthesis").alias("n_synthesis"),
        F.count_if(F.col("label") == "conventional_manipulation").alias("n_conventional"),
        F.sum("area_frac").alias("coverage"),
        F.max("confidence").alias("finding_conf"),
        strongest.alias("strongest"),
        F.transform(F.sort_array(F.collect_list(F.struct("region_id", F.col("route.primary").alias("p")))), lambda s: s["p"]).alias("routed_to"),
    )


def verdict_column(min_confidence: float = 0.35, decide_at: float = 0.5) -> Column:
    """The six-way verdict, by the first rule that holds."""
    n = F.col("n_findings")
    none = n == 0
    global_won = F.col("local_score").isNull() | (F.col("whole_image_score") >= F.col("local_score"))
    majority = F.greatest(F.lit(1), F.ceil(n / 2))
    return (
        F.when(F.col("confidence") < min_confidence, "uncertain")
        .when((F.col("score") < decide_at) & none, "likely_authentic")
        .when(F.col("score") < decide_at, "likely_authentic_with_open_questions")
        .when(global_won & (F.col("whole_image_score") >= decide_at), "ai_generated")
        .when((F.col("n_synthesis") > 0) & (F.col("coverage") >= 0.5), "ai_generated")
        .when((F.col("n_conventional") > 0) & (F.col("n_conventional") >= majority), "manipulated_not_necessarily_ai")
        .when(~none, "ai_edited")
        .otherwise("ai_generated")
    )


# Verdict -> headline.
HEADLINES = {
    "ai_generated": "Reads as generated.",
    "ai_edited": "Reads as a photograph with generated parts.",
    "manipulated_not_necessarily_ai": "Reads as edited by conventional means.",
    "likely_authentic": "No sign of generation or editing.",
    "likely_authentic_with_open_questions": "Probably authentic, with open questions.",
    "uncertain": "Too little evidence to call.",
}


def explanation(high: float = 0.75) -> Column:
    headline = F.element_at(F.create_map(*[F.lit(t) for kv in HEADLINES.items() for t in kv]), F.col("verdict"))
    top = F.col("strongest")
    where = F.concat(
        F.lit("Strongest region covers "), percent(top["area_frac"]), F.lit(", sent to "), top["route"]["primary"], F.lit(": "), top["route"]["reason"], F.lit(".")
    )
    found = F.when(F.size(top["evidence"]) > 0, F.concat(F.lit("Found: "), F.array_join(top["evidence"], "; "), F.lit(".")))
    more = F.when(F.col("n_findings") > 1, F.concat((F.col("n_findings") - 1).cast("string"), F.lit(" more region(s).")))
    nothing = F.concat(F.lit(f"No region above {round(high * 100)}%; whole-image score "), percent(F.col("whole_image_score")), F.lit("."))
    has = F.col("n_findings") > 0
    return F.concat_ws(
        " ",
        headline,
        F.when(has, where).otherwise(nothing),
        F.when(has, found),
        F.when(has, more),
        F.when(F.col("frac_uncertain") > 0.25, F.concat(percent(F.col("frac_uncertain")), F.lit(" of the map is uncertain."))),
        F.when(F.col("capped_by_calibration"), F.lit("Confidence capped: the map is uncalibrated.")),
        F.concat(F.lit("Score "), percent(F.col("score")), F.lit(", confidence "), percent(F.col("confidence")), F.lit(".")),
    )


def fuse_images(
    images: DataFrame, findings: DataFrame, calibrated: bool = False, min_confidence: float = 0.35, decide_at: float = 0.5, high: float = 0.75
) -> DataFrame:
    """Verdict per image.

    `images` holds one row per image with `whole_image_score, frac_uncertain, mean_support`.
    The local and the global reading are alternatives, so they meet in a maximum.
    """
    local = image_evidence(findings, decide_at)
    joined = images.join(local, "image_id", "left").fillna(0, ["n_findings", "n_synthesis", "n_conventional"]).fillna(0.0, ["coverage", "finding_conf"])
    decisive = F.least(F.lit(1.0), F.abs(F.col("whole_image_score") - decide_at) * 2.0)
    raw = clip(
        0.35 * (1.0 - F.col("frac_uncertain")) + 0.40 * F.greatest("finding_conf", decisive) + 0.25 * F.col("mean_support")
    )
    staged = joined.withColumns(
        {
            "score": F.greatest(F.col("whole_image_score"), F.coalesce("local_score", F.lit(0.0))),
            "uncapped_confidence": raw,
        }
    )
    if calibrated:
        staged = staged.withColumns({"confidence": F.col("uncapped_confidence"), "capped_by_calibration": F.lit(False)})
    else:
        staged = staged.withColumns(
            {
                "confidence": F.least(F.col("uncapped_confidence"), F.lit(UNCALIBRATED_CAP)),
                "capped_by_calibration": F.col("uncapped_confidence") > UNCALIBRATED_CAP,
            }
        )
    judged = staged.withColumn("verdict", verdict_column(min_confidence, decide_at))
    return judged.withColumns(
        {"explanation": explanation(high), "notes": notes(calibrated), "routed_to": F.coalesce("routed_to", F.array().cast("array<string>"))}
    )


def notes(calibrated: bool, faces_given: bool = True) -> Column:
    """Why a stage did not run."""
    none = F.col("n_findings") == 0
    return F.filter(
        F.array(
            F.lit(None if calibrated else "map is uncalibrated; confidence is capped").cast("string"),
            F.when(~none & F.lit(not faces_given), F.lit("no face boxes given; face route not taken")),
            F.when(none, F.lit("no region above the threshold; the score is the whole image's")),
        ),
        lambda t: t.isNotNull(),
    )


def nested_report(verdicts: DataFrame, findings: DataFrame, scale_factor: Column | None = None) -> DataFrame:
    """One nested report per image; an image has at most `max_regions` findings."""
    from pixelwarrant.functions.scalar import scaled_box

    factor = F.lit(1.0) if scale_factor is None else scale_factor
    finding = F.struct(
        "region_id",
        "label",
        "probability",
        "confidence",
        "bbox",
        scaled_box(F.col("bbox"), factor).alias("bbox_original"),
        "area_frac",
        F.col("route.primary").alias("routed_to"),
        F.col("route.reason").alias("routing_reason"),
        "evidence",
        F.transform("specialists", lambda s: F.struct(s["specialist"].alias("specialist"), s["result"]["probability"].alias("probability"), s["result"]["confidence"].alias("confidence"))).alias("specialists"),
    )
    packed = findings.groupBy("image_id").agg(F.sort_array(F.collect_list(finding)).alias("regions"))
    return verdicts.join(packed, "image_id", "left").select(
        "image_id",
        "verdict",
        "score",
        "confidence",
        "explanation",
        F.coalesce("regions", F.array().cast(packed.schema["regions"].dataType)).alias("regions"),
        F.struct("whole_image_score", "local_score", "coverage", "n_findings", "capped_by_calibration").alias("details"),
        "notes",
    )
