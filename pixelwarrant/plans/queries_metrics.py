"""Queries over scored rows: rank metrics, thresholds, evaluation summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from pixelwarrant import fixtures as fx
from pixelwarrant.operators import evaluation, metrics, ranks
from pixelwarrant.plans.registry import cte, query
from pixelwarrant.plans.rounding import rounded


def auc_sql(src: str, keys: str, score: str = "score", y: str = "y") -> str:
    """SQL text of the exact AUC per key."""
    part = f"partition by {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    group = f"group by {keys}" if keys else ""
    return f"""(select {lead}sum(pos*(nb+neg/2e0))/nullif(sum(pos)*sum(neg),0) as auc, sum(pos) as pos, sum(neg) as neg
  from (select *, coalesce(sum(neg) over ({part} order by sc rows between unbounded preceding and 1 preceding),0) as nb
    from (select {lead}{score} as sc, sum({y}) as pos, sum(1-{y}) as neg from {src} group by {lead}{score})) {group})"""


cte("scale_y", "select scale, score, score2, image_id, patch_no, class, (class<>'real')::int as y from patches", ("patches",))
cte(
    "family_confusion",
    """select family, sum(y)::double as pos, sum(1-y)::double as neg, sum((y=1 and p_with>=5e-1)::int)::double as tp,
  sum((y=0 and p_with>=5e-1)::int)::double as fp from arms group by family""",
    ("arms",),
)
CONFUSION_SQL = """(tp+neg-fp)/(pos+neg) as accuracy,
  (coalesce(tp/nullif(pos,0),0)+coalesce((neg-fp)/nullif(neg,0),0))/((pos>0)::int+(neg>0)::int) as balanced_accuracy,
  coalesce(2*tp/nullif(tp+fp+pos,0),0) as f1, fp/nullif(neg,0) as fpr_at_threshold"""


def _scaled(spark, sf):
    return fx.patches(spark, sf).withColumn("y", (F.col("class") != "real").cast("int"))


@query(
    "flagship_scale_separation",
    ("scale_y",),
    f"""select m.scale, m.n, round(m.accuracy,6) as accuracy, round(m.balanced_accuracy,6) as balanced_accuracy,
  round(m.f1,6) as f1, round(m.fpr_at_threshold,6) as fpr_at_threshold, round(a.auc,6) as auc,
  round(t.threshold,6) as threshold, round(coalesce(t.tpr,0),6) as tpr, round(coalesce(t.fpr,0),6) as fpr
  from (select scale, (pos+neg)::bigint as n, {CONFUSION_SQL} from
    (select scale, sum(y)::double as pos, sum(1-y)::double as neg, sum((y=1 and score>=5e-1)::int)::double as tp,
      sum((y=0 and score>=5e-1)::int)::double as fp from scale_y group by scale)) m
  join {auc_sql('scale_y', 'scale')} a on a.scale=m.scale
  left join (select scale, max_by(sc, tp*1000+sc) as threshold, max(tp/P) as tpr, max_by(fp/N, tp*1000+sc) as fpr from
    (select scale, sc, sum(pos) over (partition by scale order by sc desc) as tp, sum(neg) over (partition by scale order by sc desc) as fp,
       sum(pos) over (partition by scale) as P, sum(neg) over (partition by scale) as N from
       (select scale, score as sc, sum(y)::double as pos, sum(1-y)::double as neg from scale_y group by scale, score))
    where fp/N<=5e-2 and tp>0 group by scale) t on t.scale=m.scale""",
)
def flagship(spark, sf):
    rows = _scaled(spark, sf)
    matrix = metrics.metric_matrix(rows, ["scale"], "score", "y")
    cut = ranks.threshold_at_fpr(rows, ["scale"], "score", "y", 0.05)
    return rounded(matrix.join(cut, "scale"))


@query(
    "agg03_classification_metrics",
    ("family_confusion",),
    f"select family, round(accuracy,6) as accuracy, round(balanced_accuracy,6) as balanced_accuracy, round(f1,6) as f1 from (select family, {CONFUSION_SQL} from family_confusion)",
)
def classification_metrics(spark, sf):
    cols = metrics.confusion_metrics()
    totals = metrics.confusion_totals(fx.arms(spark, sf), ["family"], "p_with", "y")
    return rounded(totals.select("family", *[cols[n].alias(n) for n in ("accuracy", "balanced_accuracy", "f1")]))


@query(
    "agg04_false_positive_rate",
    ("family_confusion",),
    "select family, round(fp/nullif(neg,0),6) as fpr_at_threshold from family_confusion",
)
def false_positive_rate(spark, sf):
    totals = metrics.confusion_totals(fx.arms(spark, sf), ["family"], "p_with", "y")
    return rounded(totals.select("family", metrics.confusion_metrics()["fpr_at_threshold"].alias("fpr_at_threshold")))


@query(
    "agg05_exact_auc",
    ("arms",),
    f"select family, round(auc,6) as auc, pos::double as pos, neg::double as neg from {auc_sql('arms', 'family', 'p_with')}",
)
def exact_auc(spark, sf):
    return rounded(ranks.auc(fx.arms(spark, sf), ["family"], "p_with", "y"))


ROC_SQL = """(select lang, sc as threshold, sum(pos) over (partition by lang order by sc desc) as tp,
  sum(neg) over (partition by lang order by sc desc) as fp, sum(pos) over (partition by lang) as pos, sum(neg) over (partition by lang) as neg
  from (select lang, p_with as sc, sum(y)::double as pos, sum(1-y)::double as neg from arms group by lang, p_with))"""


@query(
    "agg06_threshold_at_fpr_budget",
    ("arms",),
    f"""select l.lang, round(threshold,6) as threshold, round(coalesce(tpr,0),6) as tpr, round(coalesce(fpr,0),6) as fpr
  from (select distinct lang from arms) l left join
  (select lang, max_by(threshold, tp*1000+threshold) as threshold, max(tp/pos) as tpr, max_by(fp/neg, tp*1000+threshold) as fpr
   from {ROC_SQL} where fp/neg<=5e-2 and tp>0 group by lang) t on t.lang=l.lang""",
)
def threshold_at_fpr(spark, sf):
    return rounded(ranks.threshold_at_fpr(fx.arms(spark, sf), ["lang"], "p_with", "y", 0.05))


@query(
    "agg07_severity_metric_matrix",
    ("scale_y",),
    f"""select m.scale, n, round(accuracy,6) as accuracy, round(balanced_accuracy,6) as balanced_accuracy, round(f1,6) as f1,
  round(fpr_at_threshold,6) as fpr_at_threshold, round(auc,6) as auc from
  (select scale, (pos+neg)::bigint as n, {CONFUSION_SQL} from
    (select scale, sum(y)::double as pos, sum(1-y)::double as neg, sum((y=1 and score>=5e-1)::int)::double as tp,
      sum((y=0 and score>=5e-1)::int)::double as fp from scale_y group by scale)) m
  join {auc_sql('scale_y', 'scale')} a on a.scale=m.scale""",
)
def severity_matrix(spark, sf):
    return rounded(metrics.metric_matrix(_scaled(spark, sf), ["scale"], "score", "y"))


@query(
    "win01_average_ranks",
    ("arms",),
    """select lang, round(p_with,6) as score, count(*)::double as n, round(avg(r),6) as avg_rank from
  (select lang, p_with, (row_number() over (partition by lang order by p_with))::double as r from arms) group by lang, p_with""",
)
def average_ranks(spark, sf):
    return rounded(ranks.average_ranks(fx.arms(spark, sf), ["lang"], "p_with"))


@query(
    "win02_roc_curve",
    ("arms",),
    f"select lang, round(threshold,6) as threshold, tp, fp, pos, neg, round(tp/nullif(pos,0),6) as tpr, round(fp/nullif(neg,0),6) as fpr from {ROC_SQL}",
)
def roc_curve(spark, sf):
    return rounded(ranks.roc_points(fx.arms(spark, sf), ["lang"], "p_with", "y"))


@query(
    "win03_top_mistakes",
    ("arms",),
    """select error_type, rank, id, round(p_with,6) as p_with, y from (select *, row_number() over (partition by error_type
  order by abs(p_with-5e-1) desc, id) as rank from (select *, case when y=0 and p_with>=5e-1 then 'false_positive'
  when y=1 and p_with<5e-1 then 'false_negative' end as error_type from arms) where error_type is not null) where rank<=20""",
)
def top_mistakes(spark, sf):
    rows = fx.arms(spark, sf).withColumn("p_with", F.col("p_with"))
    return rounded(metrics.top_mistakes(rows, "p_with", "y", "id", 0.5, 20).select("error_type", "rank", "id", "p_with", "y"))


LOC_SQL = """count(*) as n, round(avg(iou),6) as mean_iou, round(avg(f1),6) as mean_f1, round(avg(prec),6) as mean_precision,
  round(avg(recall),6) as mean_recall, round(avg((iou>=1e-1)::int),6) as hit_rate_10, round(avg((iou>=25e-2)::int),6) as hit_rate_25,
  round(avg((iou>=5e-1)::int),6) as hit_rate_50, round(avg((n_regions>0)::int),6) as any_region, round(avg((recall>5e-2)::int),6) as touch_rate"""


@query(
    "agg24_localisation_summary",
    ("eval_rows",),
    f"select {LOC_SQL}, round(quantile_cont(iou,0.5),6) as median_iou from eval_rows where iou is not null",
)
def localisation_summary(spark, sf):
    return rounded(evaluation.localisation_summary(fx.eval_rows(spark, sf)))


@query(
    "agg25_localisation_by_area",
    ("eval_rows",),
    """select case when true_area_frac<1e-2 then '0.00-0.01' when true_area_frac<5e-2 then '0.01-0.05' when true_area_frac<15e-2 then '0.05-0.15'
  when true_area_frac<101e-2 then '0.15-1.01' end as band, count(*) as n, round(avg(iou),6) as mean_iou, round(avg(recall),6) as mean_recall,
  round(avg((recall>5e-2)::int),6) as touch_rate from eval_rows where iou is not null group by 1""",
)
def localisation_by_area(spark, sf):
    return rounded(evaluation.localisation_by_area(fx.eval_rows(spark, sf)))


@query(
    "agg26_false_positives_on_real",
    ("eval_rows",),
    """select count(*) as n, round(coalesce(avg((n_regions>0)::int),0),6) as images_with_any_region, round(coalesce(avg(n_regions),0),6) as mean_regions,
  round(coalesce(avg(pred_area_frac),0),6) as mean_flagged_area_frac, round(coalesce(avg((not starts_with(verdict,'likely_authentic'))::int),0),6) as verdict_not_authentic
  from eval_rows where class='real'""",
)
def false_positives_on_real(spark, sf):
    return rounded(evaluation.false_positives_on_real(fx.eval_rows(spark, sf)))


@query(
    "agg27_verdict_confusion",
    ("eval_rows",),
    "select class, "
    + ", ".join(f"count(*) filter (verdict='{v}') as {v}" for v in evaluation.VERDICTS)
    + ", "
    + ", ".join(f"round(avg((verdict='{v}')::int)*100,6) as {v}_pct" for v in evaluation.VERDICTS)
    + " from eval_rows group by class",
)
def verdict_confusion(spark, sf):
    return evaluation.verdict_confusion(fx.eval_rows(spark, sf))


@query(
    "agg28_routing_counts",
    ("eval_rows",),
    "select class, "
    + ", ".join(f"count(*) filter (route='{s}') as {s}" for s in evaluation.SPECIALISTS)
    + " from (select class, unnest(routed_to) as route from eval_rows) group by class",
)
def routing_counts(spark, sf):
    return evaluation.routing_counts(fx.eval_rows(spark, sf))


cte(
    "slices",
    """select slice, label as y, score, whole_image_score from eval_rows join (values ('real','all_ai'),('real','tampered'),('real','synthetic'),
  ('tampered','all_ai'),('tampered','tampered'),('synthetic','all_ai'),('synthetic','synthetic')) m(c,slice) on c=class""",
    ("eval_rows",),
)
cte("armed", "select slice, y, 'with' as arm, score from slices union all select slice, y, 'without', whole_image_score from slices", ("slices",))


@query("agg29_detection_aucs", ("armed",), f"select slice, arm, round(auc,6) as auc, pos::double as pos, neg::double as neg from {auc_sql('armed', 'slice,arm')}")
def detection_aucs(spark, sf):
    return rounded(evaluation.detection_aucs(fx.eval_rows(spark, sf)))


@query(
    "agg30_class_means",
    ("eval_rows",),
    "select class, round(avg(confidence),6) as mean_confidence, round(avg(score),6) as mean_score, round(avg(seconds),6) as mean_seconds from eval_rows group by class",
)
def class_means(spark, sf):
    return rounded(evaluation.class_means(fx.eval_rows(spark, sf)))


def matched_sql(src: str, key: str) -> str:
    return f"""(select s.{key}, threshold, sum((y=1 and score>=threshold)::int)/sum(y)::double as recall_on_ai,
  sum((y=0 and score>=threshold)::int)/sum(1-y)::double as false_positive_rate
  from {src} s join (select {key}, quantile_cont(score,1e0-8e-1) as threshold from {src} where y=1 group by {key}) t on t.{key}=s.{key} group by s.{key}, threshold)"""


cte("arm_scores", "select 'with' as arm, y, p_with as score from arms union all select 'without', y, p_without from arms", ("arms",))


@query(
    "agg32_fpr_at_matched_recall",
    ("arm_scores",),
    f"select arm, round(threshold,6) as threshold, round(recall_on_ai,6) as recall_on_ai, round(false_positive_rate,6) as false_positive_rate from {matched_sql('arm_scores', 'arm')}",
)
def fpr_at_matched_recall(spark, sf):
    long = metrics.two_arms(fx.arms(spark, sf), "p_with", "p_without", ["y"])
    return rounded(metrics.matched_recall(long, ["arm"], "score", "y", 0.80))


@query(
    "agg33_kind_discrimination",
    ("eval_rows",),
    """select round(avg((verdict='ai_edited')::int) filter (class='tampered'),6) as tampered_called_ai_edited,
  round(avg((verdict='ai_generated')::int) filter (class='synthetic'),6) as synthetic_called_ai_generated from eval_rows""",
)
def kind_discrimination(spark, sf):
    return rounded(evaluation.kind_discrimination(fx.eval_rows(spark, sf)))


# One record per (image, condition): the window scale stands for the condition, 64 is the clean run.
cte(
    "conditioned",
    """select image_id as stem, case scale when 64 then 'clean' when 128 then 'jpeg_q60' else 'blur_s1.0' end as condition, class, y,
  max(score) as score, (max(conf_k)%100)/1e2 as confidence, (max(conf_k)%4)::int as n_regions, (['ai_edited','ai_generated','likely_authentic'])[(max(conf_k)%3+1)::int] as verdict,
  case when class='tampered' then (max(w)%101)/1e2 end as recall, case when class='tampered' then (max(h)%101)/1e2 end as iou
  from (select image_id, scale, class, (class<>'real')::int as y, score, w, h, w*31+h*17 as conf_k from patches) group by image_id, scale, class, y""",
    ("patches",),
)


def conditioned(spark, sf):
    p = fx.patches(spark, sf).withColumn("k", F.col("w") * 31 + F.col("h") * 17)
    grouped = p.groupBy("image_id", "scale", "class").agg(
        F.max("score").alias("score"), F.max("k").alias("k"), F.max("w").alias("w"), F.max("h").alias("h")
    )
    names = F.array(F.lit("ai_edited"), F.lit("ai_generated"), F.lit("likely_authentic"))
    return grouped.select(
        F.col("image_id").alias("stem"),
        F.when(F.col("scale") == 64, "clean").when(F.col("scale") == 128, "jpeg_q60").otherwise("blur_s1.0").alias("condition"),
        "class",
        (F.col("class") != "real").cast("int").alias("label"),
        "score",
        (F.col("k") % 100 / F.lit(100.0)).alias("confidence"),
        (F.col("k") % 4).cast("int").alias("n_regions"),
        F.element_at(names, (F.col("k") % 3 + 1).cast("int")).alias("verdict"),
        F.when(
            F.col("class") == "tampered",
            F.struct((F.col("w") % 101 / F.lit(100.0)).alias("recall"), (F.col("h") % 101 / F.lit(100.0)).alias("iou")),
        ).alias("localisation"),
    )


@query(
    "join02_verdict_against_clean",
    ("conditioned",),
    """select c.condition, c.verdict, k.verdict as clean_verdict, count(*) as n from conditioned c
  left join (select stem, verdict from conditioned where condition='clean') k on k.stem=c.stem group by 1,2,3""",
)
def verdict_against_clean(spark, sf):
    joined = evaluation.against_clean(conditioned(spark, sf))
    return joined.groupBy("condition", "verdict", "clean_verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg34_robustness_by_condition",
    ("conditioned",),
    f"""select b.condition, round(mean_confidence,6) as mean_confidence, round(verdict_stability,6) as verdict_stability, round(mean_recall,6) as mean_recall,
  round(mean_iou,6) as mean_iou, round(mean_regions,6) as mean_regions, round(a.auc,6) as auc_all_ai, round(t.auc,6) as auc_tampered from
  (select c.condition, avg(confidence) as mean_confidence, avg(coalesce(c.verdict=k.cv,false)::int) as verdict_stability, avg(recall) as mean_recall,
    avg(iou) as mean_iou, avg(n_regions) as mean_regions from conditioned c
    left join (select stem, verdict as cv from conditioned where condition='clean') k on k.stem=c.stem group by c.condition) b
  join {auc_sql('conditioned', 'condition')} a on a.condition=b.condition
  join {auc_sql("(select * from conditioned where class<>'synthetic')", 'condition')} t on t.condition=b.condition""",
)
def robustness_by_condition(spark, sf):
    return rounded(evaluation.robustness_by_condition(conditioned(spark, sf)))


@query(
    "agg42_prediction_diagnostics",
    ("arms",),
    """select family, round(avg(p_with),6) as pred_mean, round(stddev_pop(p_with),6) as pred_std, round(min(p_with),6) as pred_min, round(max(p_with),6) as pred_max,
  round(avg(p_with) filter (y=0),6) as mean_on_real, round(avg(p_with) filter (y=1),6) as mean_on_fake, round(avg((p_with>5e-1)::int),6) as frac_predicted_fake,
  round(avg(p_with) filter (y=1)-avg(p_with) filter (y=0),6) as separation, round(quantile_cont(p_with,0.01),6) as p01, round(quantile_cont(p_with,0.5),6) as p50,
  round(quantile_cont(p_with,0.99),6) as p99 from arms group by family""",
)
def prediction_diagnostics(spark, sf):
    return rounded(metrics.prediction_diagnostics(fx.arms(spark, sf), ["family"], "p_with", "y"))


PROBE_DIMS = range(64)
cte(
    "scalars",
    " union all ".join(f"select family, y, {d} as scalar, features[{d + 1}]::double as score from feat" for d in PROBE_DIMS),
    ("feat",),
)


@query(
    "agg43_confound_probe",
    ("scalars",),
    f"""select family, scalar, worst_auc from (select *, row_number() over (partition by family order by worst_auc desc, scalar) as r from
  (select family, scalar, round(greatest(auc,1-auc),6) as worst_auc from {auc_sql('scalars', 'family,scalar')} where auc is not null)) where r=1""",
)
def confound_probe(spark, sf):
    return rounded(metrics.confound_probe(fx.feat(spark, sf), "family", "y", "features", PROBE_DIMS))


@query(
    "agg44_share_above_high_threshold",
    ("patches",),
    "select scale, class, round(avg((score>=75e-2)::int),6) as share_above, count(*) as n from patches group by scale, class",
)
def share_above(spark, sf):
    return rounded(
        fx.patches(spark, sf)
        .groupBy("scale", "class")
        .agg(F.avg((F.col("score") >= 0.75).cast("double")).alias("share_above"), F.count(F.lit(1)).alias("n"))
    )


cte(
    "image_p90",
    """select image_id, class, (class<>'real')::int as y, round(quantile_cont(score,9e-1),9) as score from
  (select *, row_number() over (partition by image_id order by (patch_no*7919+image_id*31)%1009, patch_no) as r from patches) where r<=12 group by 1,2,3""",
    ("patches",),
)


@query(
    "agg46_image_objective",
    ("image_p90",),
    f"""select slice, round(auc,6) as auc, round(mean_real,6) as mean_real, round(mean_ai,6) as mean_ai from
  (select a.slice, a.auc, m.mean_real, m.mean_ai from {auc_sql("(select slice, y, score from image_p90 join (values ('real','all_ai'),('real','tampered'),('real','synthetic'),('tampered','all_ai'),('tampered','tampered'),('synthetic','all_ai'),('synthetic','synthetic')) m(c,slice) on c=class)", 'slice')} a
  join (select slice, avg(score) filter (y=0) as mean_real, avg(score) filter (y=1) as mean_ai from image_p90 join (values ('real','all_ai'),('real','tampered'),('real','synthetic'),('tampered','all_ai'),('tampered','tampered'),('synthetic','all_ai'),('synthetic','synthetic')) m(c,slice) on c=class group by slice) m on m.slice=a.slice)""",
)
def image_objective(spark, sf):
    p = fx.patches(spark, sf).withColumn("_h", (F.col("patch_no") * 7919 + F.col("image_id") * 31) % 1009)
    sample = ranks.top_k(p, ["image_id"], [F.col("_h"), F.col("patch_no")], 12)
    image = sample.groupBy("image_id", "class").agg(F.round(F.percentile("score", 0.9), 9).alias("score"))
    sliced = metrics.slice_memberships(image).withColumn("label", (F.col("class") != "real").cast("int"))
    means = sliced.groupBy("slice").agg(
        F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("mean_real"),
        F.avg(F.when(F.col("label") == 1, F.col("score"))).alias("mean_ai"),
    )
    return rounded(ranks.auc(sliced, ["slice"], "score", "label").select("slice", "auc").join(means, "slice"))


@query(
    "prj30_threshold_labels",
    ("arms",),
    f"""select a.id, round(p_with,6) as pred, (p_with>=5e-1)::int as label_default, (p_with>=coalesce(t.threshold,'inf'::double))::int as label_budget from arms a left join
  (select max_by(threshold, tp*1000+threshold) as threshold from (select sc as threshold, sum(pos) over (order by sc desc) as tp, sum(neg) over (order by sc desc) as fp,
     sum(neg) over () as neg from (select p_with as sc, sum(y)::double as pos, sum(1-y)::double as neg from arms group by p_with)) where fp/neg<=5e-2 and tp>0) t on true""",
)
def threshold_labels(spark, sf):
    rows = fx.arms(spark, sf)
    cut = ranks.threshold_at_fpr(rows, [], "p_with", "y", 0.05).select("threshold").scalar()
    return rounded(
        rows.select(
            "id",
            F.col("p_with").alias("pred"),
            (F.col("p_with") >= 0.5).cast("int").alias("label_default"),
            F.coalesce(F.col("p_with") >= cut, F.lit(False)).cast("int").alias("label_budget"),
        )
    )


@query(
    "prj31_seen_or_held_out",
    ("arms",),
    """select family, case when t.f is null then 'HELD OUT' else 'SEEN' end as tag, n from (select family, count(*) as n from arms group by family) a
  left join (select distinct source as f from documents where source < 'src15') t on t.f=a.family""",
)
def seen_or_held_out(spark, sf):
    scored = fx.arms(spark, sf).groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    trained = fx.table(spark, sf, "documents").where(F.col("source") < "src15").select(F.col("source").alias("family")).distinct()
    return scored.join(trained.withColumn("_seen", F.lit(True)), "family", "left").select(
        "family", F.when(F.col("_seen"), "SEEN").otherwise("HELD OUT").alias("tag"), "n"
    )


@query(
    "prj32_scorer_health",
    ("arm_scores",),
    f"select arm, round(auc,6) as auc, case when auc>=6e-1 then 'CORRECT' when auc<=1e0-6e-1 then 'INVERTED' else 'NON-DISCRIMINATIVE' end as verdict from {auc_sql('arm_scores', 'arm')}",
)
def scorer_health(spark, sf):
    long = metrics.two_arms(fx.arms(spark, sf), "p_with", "p_without", ["y"])
    scored = ranks.auc(long, ["arm"], "score", "y")
    return rounded(scored.select("arm", "auc", metrics.scorer_health(F.col("auc")).alias("verdict")))


@query(
    "prj33_spread_verdict",
    ("arms",),
    f"""select a.family, case when s<2e-2 then 'COLLAPSED' when abs(auc-5e-1)<3e-2 then 'NO SIGNAL' else 'WEAK SIGNAL PRESENT' end as verdict
  from (select family, stddev_pop(p_without) as s from arms group by family) a join {auc_sql('arms', 'family', 'p_without')} u on u.family=a.family""",
)
def spread_verdict(spark, sf):
    rows = fx.arms(spark, sf)
    spread = rows.groupBy("family").agg(F.stddev_pop("p_without").alias("s"))
    aucs = ranks.auc(rows, ["family"], "p_without", "y").select("family", "auc")
    return spread.join(aucs, "family").select("family", metrics.spread_verdict(F.col("s"), F.col("auc")).alias("verdict"))


@query(
    "prj34_ablation_conclusions",
    ("arms",),
    f"""select family, round(auc_with,6) as auc_with, round(delta,6) as delta, case when ci_low>0 and delta>0 then 'helps' when ci_high<0 and delta<0 then 'hurts' else 'no_measurable_difference' end as detection,
  case when ci_low>0 and delta>0 and auc_with>=75e-2 and mean_iou>=25e-2 then 'works' when ci_low>0 and delta>0 and (touch_rate>=5e-1 or mean_iou>=25e-2) then 'directionally_validated'
   when ci_low>0 and delta>0 then 'scoring_only' when ci_high<0 and delta<0 then 'does_not_work_discards_signal' when mean_iou>=25e-2 then 'localisation_only' else 'does_not_work_yet' end as overall,
  case when fpr_with<fpr_without then 'fewer' when fpr_with>fpr_without then 'more' else 'the same' end as false_positives, fpr_with>25e-2 as not_deployable
  from (select w.family, w.auc as auc_with, w.auc-o.auc as delta, w.auc-o.auc-1e-1 as ci_low, w.auc-o.auc+1e-1 as ci_high, m.mean_iou, m.touch_rate, m.fpr_with, m.fpr_without
   from {auc_sql('arms', 'family', 'p_with')} w join {auc_sql('arms', 'family', 'p_without')} o on o.family=w.family
   join (select family, avg(p_without) filter (y=1) as mean_iou, avg((p_without>5e-2)::int) filter (y=1) as touch_rate, avg((p_with>=5e-1)::int) filter (y=0) as fpr_with,
     avg((p_without>=5e-1)::int) filter (y=0) as fpr_without from arms group by family) m on m.family=w.family)""",
)
def ablation_conclusions(spark, sf):
    rows = fx.arms(spark, sf)
    aucs = (
        ranks.auc(metrics.two_arms(rows, "p_with", "p_without", ["family", "y"]), ["family", "arm"], "score", "y")
        .groupBy("family")
        .agg(
            F.max(F.when(F.col("arm") == "with", F.col("auc"))).alias("auc_with"),
            F.max(F.when(F.col("arm") == "without", F.col("auc"))).alias("auc_without"),
        )
        .withColumn("delta", F.col("auc_with") - F.col("auc_without"))
    )
    ai, real = F.col("y") == 1, F.col("y") == 0
    rates = rows.groupBy("family").agg(
        F.avg(F.when(ai, F.col("p_without"))).alias("mean_iou"),
        F.avg(F.when(ai, (F.col("p_without") > 0.05).cast("double"))).alias("touch_rate"),
        F.avg(F.when(real, (F.col("p_with") >= 0.5).cast("double"))).alias("fpr_with"),
        F.avg(F.when(real, (F.col("p_without") >= 0.5).cast("double"))).alias("fpr_without"),
    )
    one_row = aucs.join(rates, "family").select(
        "*",
        (F.col("delta") - 0.1).alias("ci_low"),
        (F.col("delta") + 0.1).alias("ci_high"),
        F.lit(0.0).alias("syn_delta"),
        F.lit(0.0).alias("syn_ci_low"),
        F.lit(0.0).alias("syn_ci_high"),
    )
    out = evaluation.ablation_conclusions(one_row)
    return rounded(out.select("family", "auc_with", "delta", "detection", "overall", "false_positives", "not_deployable"))


@query(
    "srt04_ranked_by_auc",
    ("arms",),
    f"select family, round(auc,6) as auc from {auc_sql('arms', 'family', 'p_with')} order by auc desc",
)
def ranked_by_auc(spark, sf):
    return rounded(ranks.auc(fx.arms(spark, sf), ["family"], "p_with", "y").select("family", "auc")).orderBy(F.col("auc").desc(), "family")


@query(
    "srt03_hard_negatives",
    ("patches",),
    "select image_id, patch_no, round(score,6) as score from patches where class='real' order by score desc, image_id, patch_no limit 200",
)
def hard_negatives(spark, sf):
    real = fx.patches(spark, sf).where(F.col("class") == "real")
    return rounded(real.orderBy(F.col("score").desc(), "image_id", "patch_no").limit(200).select("image_id", "patch_no", "score"))
