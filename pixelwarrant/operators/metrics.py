"""Classification metrics as single-pass aggregates over scored rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelwarrant.operators import ranks


def confusion_metrics() -> dict[str, Column]:
    """Metric columns over `pos, neg, tp, fp` totals."""
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    tn = neg - fp
    recall, specificity = F.try_divide(tp, pos), F.try_divide(tn, neg)
    present = (pos > 0).cast("int") + (neg > 0).cast("int")
    return {
        "accuracy": F.try_divide(tp + tn, pos + neg),
        "balanced_accuracy": F.try_divide(
            F.coalesce(recall, F.lit(0.0)) + F.coalesce(specificity, F.lit(0.0)), present
        ),
        "f1": F.coalesce(F.try_divide(2 * tp, tp + fp + pos), F.lit(0.0)),
        "fpr_at_threshold": F.try_divide(fp, neg),
    }


def confusion_totals(
    df: DataFrame, keys: Sequence[str], score: str, label: str, threshold: float = 0.5
) -> DataFrame:
    hit = F.col(score) >= F.lit(threshold)
    one = lambda cond: F.sum(F.when(cond, 1.0).otherwise(0.0))
    return df.groupBy(*keys).agg(
        one(F.col(label) == 1).alias("pos"),
        one(F.col(label) == 0).alias("neg"),
        one((F.col(label) == 1) & hit).alias("tp"),
        one((F.col(label) == 0) & hit).alias("fp"),
    )


def metric_matrix(
    df: DataFrame, keys: Sequence[str], score: str | Column, label: str | Column, threshold: float = 0.5
) -> DataFrame:
    """Accuracy, balanced accuracy, F1, AUC and FPR per key, from one pre-aggregated pass."""
    counts = ranks.score_counts(df, keys, score, label)
    summary = ranks.rank_summary(counts, keys, threshold)
    cols = confusion_metrics()
    return summary.select(
        *keys,
        (F.col("pos") + F.col("neg")).cast("long").alias("n"),
        *[c.alias(n) for n, c in cols.items()],
        ranks.auc_column().alias("auc"),
    )


def slice_memberships(df: DataFrame, class_col: str = "class") -> DataFrame:
    """Expand rows into the overlapping detection slices, real rows serving every slice."""
    return df.withColumn(
        "slice",
        F.explode(
            F.when(F.col(class_col) == "real", F.array(F.lit("all_ai"), F.lit("tampered"), F.lit("synthetic")))
            .when(F.col(class_col) == "tampered", F.array(F.lit("all_ai"), F.lit("tampered")))
            .otherwise(F.array(F.lit("all_ai"), F.lit("synthetic")))
        ),
    )


def two_arms(df: DataFrame, with_score: str, without_score: str, keep: Sequence[str]) -> DataFrame:
    """Long form of a paired table: one row per item and arm."""
    return df.select(
        *keep,
        F.explode(
            F.array(
                F.struct(F.lit("with").alias("arm"), F.col(with_score).alias("score")),
                F.struct(F.lit("without").alias("arm"), F.col(without_score).alias("score")),
            )
        ).alias("_a"),
    ).select(*keep, "_a.arm", "_a.score")


def matched_recall(
    df: DataFrame, keys: Sequence[str], score: str, label: str, recall: float = 0.80
) -> DataFrame:
    """Threshold at the (1 - recall) quantile of the positives, and the rates it gives."""
    keys = list(keys)
    cut = ranks.quantiles(df.where(F.col(label) == 1), keys, score, [1.0 - recall]).select(
        *keys, F.col("value").alias("threshold")
    )
    counts = ranks.score_counts(df, keys, score, label)
    joined = counts.join(cut, keys) if keys else counts.withColumn("threshold", cut.scalar())
    hit = F.col("score") >= F.col("threshold")
    return (
        joined.groupBy(*keys, "threshold")
        .agg(
            F.sum("pos").alias("_p"),
            F.sum("neg").alias("_n"),
            F.sum(F.when(hit, F.col("pos")).otherwise(0.0)).alias("_tp"),
            F.sum(F.when(hit, F.col("neg")).otherwise(0.0)).alias("_fp"),
        )
        .select(
            *keys,
            "threshold",
            F.try_divide("_tp", "_p").alias("recall_on_ai"),
            F.try_divide("_fp", "_n").alias("false_positive_rate"),
        )
    )


def prediction_diagnostics(df: DataFrame, keys: Sequence[str], score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Spread of the predictions, class means and separation, and the share predicted fake (strict `>`)."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(
        F.avg(score).alias("pred_mean"),
        F.stddev_pop(score).alias("pred_std"),
        F.min(score).alias("pred_min"),
        F.max(score).alias("pred_max"),
        F.avg(F.when(F.col(label) == 0, F.col(score))).alias("mean_on_real"),
        F.avg(F.when(F.col(label) == 1, F.col(score))).alias("mean_on_fake"),
        F.avg((F.col(score) > threshold).cast("double")).alias("frac_predicted_fake"),
    )
    base = base.withColumn("separation", F.col("mean_on_fake") - F.col("mean_on_real"))
    q = ranks.quantiles(df, keys, score, [0.01, 0.5, 0.99])
    wide = q.groupBy(*keys).agg(
        F.max(F.when(F.col("q") == 0.01, F.col("value"))).alias("p01"),
        F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("p50"),
        F.max(F.when(F.col("q") == 0.99, F.col("value"))).alias("p99"),
    )
    return base.join(wide, keys)


def scorer_health(auc: Column, min_auc: float = 0.60) -> Column:
    return (
        F.when(auc >= min_auc, "CORRECT").when(auc <= 1.0 - min_auc, "INVERTED").otherwise("NON-DISCRIMINATIVE")
    )


def spread_verdict(std: Column, auc: Column) -> Column:
    return (
        F.when(std < 0.02, "COLLAPSED").when(F.abs(auc - 0.5) < 0.03, "NO SIGNAL").otherwise("WEAK SIGNAL PRESENT")
    )


def top_mistakes(df: DataFrame, score: str, label: str, item: str, threshold: float, k: int) -> DataFrame:
    """The most confident false positives and false negatives."""
    hit = F.col(score) >= threshold
    wrong = df.withColumn(
        "error_type",
        F.when((F.col(label) == 0) & hit, "false_positive").when((F.col(label) == 1) & ~hit, "false_negative"),
    ).where(F.col("error_type").isNotNull())
    gap = F.abs(F.col(score) - threshold)
    return ranks.top_k(wrong, ["error_type"], [gap.desc(), F.col(item)], k)


def confound_probe(df: DataFrame, family: str, label: str, features: str, dims: Sequence[int]) -> DataFrame:
    """How well any single scalar separates the classes, per family; the worst one is kept."""
    long = df.select(
        family,
        label,
        F.explode(
            F.array(*[F.struct(F.lit(d).alias("scalar"), F.col(features)[d].cast("double").alias("value")) for d in dims])
        ).alias("_s"),
    ).select(family, label, "_s.scalar", "_s.value")
    each = ranks.auc(long, [family, "scalar"], "value", label)
    best = each.where(F.col("auc").isNotNull()).withColumn("worst_auc", F.greatest(F.col("auc"), 1 - F.col("auc")))
    spec = Window.partitionBy(family).orderBy(F.col("worst_auc").desc(), "scalar")
    return best.withColumn("_r", F.row_number().over(spec)).where("_r = 1").select(family, "scalar", "worst_auc")
