"""Summaries of an evaluation run: localisation, false positives, verdicts, routing, robustness."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelwarrant.operators import metrics, ranks

# True-area bands [low, high) and the verdict names.
AREA_BANDS = ((0.0, 0.01), (0.01, 0.05), (0.05, 0.15), (0.15, 1.01))
VERDICTS = (
    "ai_generated",
    "ai_edited",
    "manipulated_not_necessarily_ai",
    "likely_authentic",
    "likely_authentic_with_open_questions",
    "uncertain",
)
SPECIALISTS = ("inpainting", "synthesis", "face_edit", "compositing", "fallback")


def share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def localisation_columns() -> list[Column]:
    iou, recall = F.col("localisation.iou"), F.col("localisation.recall")
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(iou).alias("mean_iou"),
        F.avg("localisation.f1").alias("mean_f1"),
        F.avg("localisation.precision").alias("mean_precision"),
        F.avg(recall).alias("mean_recall"),
        share(iou >= 0.10).alias("hit_rate_10"),
        share(iou >= 0.25).alias("hit_rate_25"),
        share(iou >= 0.50).alias("hit_rate_50"),
        share(F.col("n_regions") > 0).alias("any_region"),
        share(recall > 0.05).alias("touch_rate"),
    ]


def localisation_summary(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Localisation quality of the masked rows; the median is exact at any size."""
    masked = rows.where(F.col("localisation").isNotNull())
    keys = list(keys)
    if not keys:
        masked, keys = masked.withColumn("_k", F.lit(0)), ["_k"]
    base = masked.groupBy(*keys).agg(*localisation_columns())
    median = ranks.quantiles(masked, keys, F.col("localisation.iou"), [0.5]).select(
        *keys, F.col("value").alias("median_iou")
    )
    return base.join(median, keys).drop("_k")


def area_band(area: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high in reversed(AREA_BANDS):
        out = F.when((area >= low) & (area < high), f"{low:.2f}-{high:.2f}").otherwise(out)
    return out


def localisation_by_area(rows: DataFrame) -> DataFrame:
    """Stratified by true edit size; bands without rows are absent."""
    recall = F.col("localisation.recall")
    return (
        rows.where(F.col("localisation").isNotNull())
        .withColumn("band", area_band(F.col("localisation.true_area_frac")))
        .where(F.col("band").isNotNull())
        .groupBy("band")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("localisation.iou").alias("mean_iou"),
            F.avg(recall).alias("mean_recall"),
            share(recall > 0.05).alias("touch_rate"),
        )
    )


def false_positives_on_real(rows: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return rows.where(F.col("class") == "real").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(share(F.col("n_regions") > 0), zero).alias("images_with_any_region"),
        F.coalesce(F.avg("n_regions"), zero).alias("mean_regions"),
        F.coalesce(F.avg("pred_area_frac"), zero).alias("mean_flagged_area_frac"),
        F.coalesce(share(~F.col("verdict").startswith("likely_authentic")), zero).alias("verdict_not_authentic"),
    )


def verdict_confusion(rows: DataFrame) -> DataFrame:
    """Class x verdict counts and row shares; the column set is fixed, so no scan finds it."""
    return rows.groupBy("class").agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS],
        *[F.round(share(F.col("verdict") == v) * 100, 6).alias(f"{v}_pct") for v in VERDICTS],
    )


def routing_counts(rows: DataFrame) -> DataFrame:
    routed = rows.select("class", F.explode("routed_to").alias("route"))
    return routed.groupBy("class").agg(*[F.count_if(F.col("route") == s).alias(s) for s in SPECIALISTS])


def detection_aucs(rows: DataFrame) -> DataFrame:
    """AUC of both arms over the three overlapping positive slices."""
    long = metrics.two_arms(
        metrics.slice_memberships(rows), "score", "whole_image_score", ["slice", "label"]
    )
    return ranks.auc(long, ["slice", "arm"], "score", "label")


def class_means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("class").agg(
        F.avg("confidence").alias("mean_confidence"),
        F.avg("score").alias("mean_score"),
        F.avg("seconds").alias("mean_seconds"),
    )


def kind_discrimination(rows: DataFrame) -> DataFrame:
    """Edited photos called edited and generated images called generated; NULL for an absent class."""
    right = lambda cls, verdict: F.avg(F.when(F.col("class") == cls, (F.col("verdict") == verdict).cast("double")))
    return rows.agg(
        right("tampered", "ai_edited").alias("tampered_called_ai_edited"),
        right("synthetic", "ai_generated").alias("synthetic_called_ai_generated"),
    )


def against_clean(rows: DataFrame, condition: str = "condition", clean: str = "clean") -> DataFrame:
    """Attach the clean verdict of the same stem to every conditioned row."""
    base = rows.where(F.col(condition) == clean).select("stem", F.col("verdict").alias("clean_verdict"))
    return rows.join(base, "stem", "left")


def robustness_by_condition(rows: DataFrame) -> DataFrame:
    """Per condition: AUCs, confidence, verdict stability against clean, localisation, regions."""
    with_clean = against_clean(rows)
    base = with_clean.groupBy("condition").agg(
        F.avg("confidence").alias("mean_confidence"),
        F.avg(F.coalesce(F.col("verdict") == F.col("clean_verdict"), F.lit(False)).cast("double")).alias(
            "verdict_stability"
        ),
        F.avg("localisation.recall").alias("mean_recall"),
        F.avg("localisation.iou").alias("mean_iou"),
        F.avg("n_regions").alias("mean_regions"),
    )
    sliced = metrics.slice_memberships(rows).where(F.col("slice") != "synthetic")
    aucs = (
        ranks.auc(sliced, ["condition", "slice"], "score", "label")
        .groupBy("condition")
        .agg(
            F.max(F.when(F.col("slice") == "all_ai", F.col("auc"))).alias("auc_all_ai"),
            F.max(F.when(F.col("slice") == "tampered", F.col("auc"))).alias("auc_tampered"),
        )
    )
    return base.join(aucs, "condition")


def decision_sweep(reduced: DataFrame, keys: Sequence[str] = ("reduction",)) -> DataFrame:
    """Rank ways of reducing a map to one score: AUCs of the three slices and FPR at 80% recall.

    Both parts read one pre-aggregated (reduction, slice, score) table.
    """
    sliced = metrics.slice_memberships(reduced)
    aucs = (
        ranks.auc(sliced, [*keys, "slice"], "score", "label")
        .groupBy(*keys)
        .agg(
            *[
                F.max(F.when(F.col("slice") == s, F.col("auc"))).alias(n)
                for s, n in (
                    ("all_ai", "auc_real_vs_ai"),
                    ("synthetic", "auc_real_vs_fully_ai"),
                    ("tampered", "auc_real_vs_partially_ai"),
                )
            ]
        )
    )
    matched = metrics.matched_recall(reduced, list(keys), "score", "label", 0.80).select(
        *keys, F.col("false_positive_rate").alias("fpr_at_80_recall")
    )
    return aucs.join(matched, list(keys)).orderBy(F.col("auc_real_vs_ai").desc(), *keys)


def map_reductions(cells: DataFrame, keys: Sequence[str], heat: str = "heat", cuts: Sequence[float] = (0.5, 0.6, 0.7, 0.75, 0.8, 0.9)) -> DataFrame:
    """One score per map and reduction, in long form. A map's cells are bounded by its working size."""
    wide = cells.groupBy(*keys).agg(
        F.max(heat).alias("max"),
        F.percentile(heat, [0.99, 0.95, 0.9]).alias("_p"),
        F.avg(heat).alias("mean"),
        *[share(F.col(heat) >= c).alias(f"frac_above_{c}") for c in cuts],
    )
    named = [("max", F.col("max")), ("p99", F.col("_p")[0]), ("p95", F.col("_p")[1]), ("p90", F.col("_p")[2]), ("mean", F.col("mean"))]
    named += [(f"frac_above_{c}", F.col(f"`frac_above_{c}`")) for c in cuts]
    return wide.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(n).alias("reduction"), c.alias("score")) for n, c in named])).alias("_r"),
    ).select(*keys, "_r.reduction", "_r.score")


def ablation_conclusions(df: DataFrame) -> DataFrame:
    """Rule columns over one row of results: what the paired comparison supports.

    Expects `delta, ci_low, ci_high, auc_with` of the tampered slice, the same with the
    prefix `syn_` for the synthetic slice, `fpr_with`, `fpr_without`, `mean_iou`, `touch_rate`.
    """
    significant = (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    syn_significant = (F.col("syn_ci_low") > 0) | (F.col("syn_ci_high") < 0)
    helped = significant & (F.col("delta") > 0)
    hurt = significant & (F.col("delta") < 0)
    strong = F.col("auc_with") >= 0.75
    localises = F.col("touch_rate") >= 0.5
    localises_well = F.col("mean_iou") >= 0.25
    return df.select(
        "*",
        F.when(helped, "helps").when(hurt, "hurts").otherwise("no_measurable_difference").alias("detection"),
        F.when(F.col("fpr_with") < F.col("fpr_without"), "fewer")
        .when(F.col("fpr_with") > F.col("fpr_without"), "more")
        .otherwise("the same")
        .alias("false_positives"),
        F.when(syn_significant & (F.col("syn_delta") > 0), "gains")
        .when(syn_significant & (F.col("syn_delta") < 0), "loses")
        .otherwise("unchanged")
        .alias("synthetic"),
        F.when(helped & strong & localises_well, "works")
        .when(helped & (localises | localises_well), "directionally_validated")
        .when(helped, "scoring_only")
        .when(hurt, "does_not_work_discards_signal")
        .when(localises_well, "localisation_only")
        .otherwise("does_not_work_yet")
        .alias("overall"),
        (syn_significant & (F.col("syn_delta") < -0.02)).alias("is_trade"),
        (F.col("fpr_with") > 0.25).alias("not_deployable"),
        F.format_string(
            "AUC %.3f -> %.3f (delta %+.3f, 95%% CI [%+.3f, %+.3f])",
            F.col("auc_with") - F.col("delta"),
            F.col("auc_with"),
            F.col("delta"),
            F.col("ci_low"),
            F.col("ci_high"),
        ).alias("summary"),
    )
