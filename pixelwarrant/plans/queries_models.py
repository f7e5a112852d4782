"""Queries over calibration, labels, features, models, bootstrap and streams."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pixelwarrant import fixtures as fx
from pixelwarrant.functions import scalar, udfs
from pixelwarrant.operators import boosting, bootstrap, calibration, features, labels, models, ranks
from pixelwarrant.operators.dataset import split_by_group
from pixelwarrant.plans.queries_dataset import FEATURE_BLOCKS
from pixelwarrant.plans.queries_metrics import _scaled, auc_sql
from pixelwarrant.plans.registry import cte, query
from pixelwarrant.plans.rounding import rounded
from pixelwarrant.sources import tables
from pixelwarrant.streaming import jobs

# --- calibration --------------------------------------------------------------------------

KNOTS = [(0.15, 0.05), (0.5, 0.3), (0.85, 0.9)]
CALIBRATORS = [(64, "platt", 1.2, -0.3, None, True), (128, "isotonic", None, None, KNOTS, True), (None, "platt", 0.8, 0.1, None, True)]
LOGIT = "ln(greatest(1e-6,least(1-1e-6,score))/(1-greatest(1e-6,least(1-1e-6,score))))"
cte(
    "calibrated",
    f"""select image_id, patch_no, scale, y, score as raw, case scale when 64 then 1/(1+exp(-(12e-1*{LOGIT}-3e-1))) when 128 then
   case when score<15e-2 then 5e-2 when score>=85e-2 then 9e-1 when score<5e-1 then 5e-2+(3e-1-5e-2)*(score-15e-2)/(5e-1-15e-2) else 3e-1+(9e-1-3e-1)*(score-5e-1)/(85e-2-5e-1) end
   else 1/(1+exp(-(8e-1*{LOGIT}+1e-1))) end as q from scale_y""",
    ("scale_y",),
)


def calibrated_patches(spark, sf):
    cals = spark.createDataFrame(CALIBRATORS, calibration.SCHEMA)
    return calibration.calibrated(_scaled(spark, sf).withColumn("raw", F.col("score")), cals)


@query("prj21_calibrator_apply", ("calibrated",), "select image_id, patch_no, scale, round(raw,6) as raw, round(q,6) as score from calibrated")
def calibrator_apply(spark, sf):
    return rounded(calibrated_patches(spark, sf).select("image_id", "patch_no", "scale", "raw", "score"))


@query("join07_calibrator_by_scale", ("calibrated",), "select scale, count(*) as n, round(avg(raw),6) as mean_raw, round(avg(q),6) as mean_calibrated from calibrated group by scale")
def calibrator_by_scale(spark, sf):
    return rounded(
        calibrated_patches(spark, sf).groupBy("scale").agg(F.count(F.lit(1)).alias("n"), F.avg("raw").alias("mean_raw"), F.avg("score").alias("mean_calibrated"))
    )


EDGES = "[" + ",".join(f"{i * 0.1!r}::double" for i in range(1, 10)) + "]"


@query(
    "agg10_calibration_error",
    ("scale_y",),
    f"""select scale, round(sum(n*abs(p-yy))/sum(n),6) as ece, sum(n)::bigint as n from (select scale, len(list_filter({EDGES}, lambda e: e<=score)) as bin, count(*) as n, avg(score) as p, avg(y) as yy from scale_y group by 1,2) group by scale""",
)
def calibration_error(spark, sf):
    return rounded(calibration.calibration_error(_scaled(spark, sf), ["scale"], "score", "y"))


@query(
    "agg11_platt_fit",
    ("arms",),
    """select count(*) as n, sum(y)::bigint as positives, round(avg(y),6) as mean_fitted, round(avg(y*z),5) as mean_fitted_logit from
  (select y, ln(p/(1-p)) as z from (select y, greatest(1e-6,least(1-1e-6,p_with)) as p from arms))""",
)
def platt_fit(spark, sf):
    """At the most likely curve the fitted probabilities have the labels' mean, and the labels' mean product with the logit."""
    arms = fx.arms(spark, sf)
    a, b = calibration.fit_platt(arms, "p_with", "y")
    p = scalar.sigmoid(F.lit(a) * scalar.logit(F.col("p_with")) + F.lit(b))
    return arms.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("y").alias("positives"),
        F.round(F.avg(p), 6).alias("mean_fitted"),
        F.round(F.avg(p * scalar.logit(F.col("p_with"))), 5).alias("mean_fitted_logit"),
    )


cte(
    "ranked",
    """select x, s, n, row_number() over (order by x) as i, sum(s) over (order by x) as cs, sum(n) over (order by x) as cn from
  (select p_with as x, sum(y)::double as s, count(*)::double as n from arms group by 1)""",
    ("arms",),
)


@query(
    "agg12_isotonic_fit",
    ("ranked",),
    """select round(unnest(list_distinct([x0,x1])),6) as x, y from (select round(y,6) as y, min(x) as x0, max(x) as x1 from
  (select x, max(low) as y from (select i.x, j.i as j, min((k.cs-j.cs+j.s)/(k.cn-j.cn+j.n)) as low from ranked i join ranked j on j.i<=i.i join ranked k on k.i>=i.i group by 1,2) group by x) group by 1)""",
)
def isotonic_fit(spark, sf):
    """Both ends of every level of the staircase."""
    found = calibration.isotonic_levels(ranks.score_counts(fx.arms(spark, sf), [], "p_with", "y"))
    return rounded(found.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), "y"))


cte("split_scores", "select scale, score, y, (image_id*131+patch_no*17)%1000 < 300 as val from scale_y", ("scale_y",))
cte(
    "fit_points",
    """select scale, val, score as x, sum(y)::double as s, count(*)::double as n from split_scores group by all union all
  select null, val, score, sum(y)::double, count(*)::double from split_scores group by all""",
    ("split_scores",),
)
cte(
    "fit_ranked",
    """select scale, x, s, n, row_number() over w as i, sum(s) over w as cs, sum(n) over w as cn, sum(n) over (partition by scale) as total from fit_points where not val
  window w as (partition by scale order by x)""",
    ("fit_points",),
)
cte(
    "fit_knots",
    """select f.scale, f.x, max(low) as y from (select i.scale, i.x, j.i as j, min((k.cs-j.cs+j.s)/(k.cn-j.cn+j.n)) as low from fit_ranked i join fit_ranked j on j.scale is not distinct from i.scale and j.i<=i.i
   join fit_ranked k on k.scale is not distinct from i.scale and k.i>=i.i
   where exists (select 1 from (select unnest(range(64)) as h) where round_even(h*(i.total-1)/63,0)>=i.cn-i.n and round_even(h*(i.total-1)/63,0)<i.cn) group by all) f group by all""",
    ("fit_ranked",),
)
cte(
    "fit_applied",
    """select p.*, case when lo.x is null then hi.y when hi.x is null then lo.y when hi.x=lo.x then lo.y else lo.y+(hi.y-lo.y)*(p.x-lo.x)/(hi.x-lo.x) end as q from
  (select *, (select max(x) from fit_knots k where k.scale is not distinct from p0.scale and k.x<=p0.x) as lx, (select min(x) from fit_knots k where k.scale is not distinct from p0.scale and k.x>=p0.x) as hx from fit_points p0 where val) p
  left join fit_knots lo on lo.scale is not distinct from p.scale and lo.x=p.lx left join fit_knots hi on hi.scale is not distinct from p.scale and hi.x=p.hx""",
    ("fit_points", "fit_knots"),
)


@query(
    "agg13_fits_per_scale",
    ("fit_points", "fit_applied"),
    f"""select t.scale::int as scale, t.n::bigint as n, round(b.ece,6) as ece_before, round(a.ece,6) as ece_after, a.ece<b.ece as kept, null::varchar as skipped
  from (select scale, sum(n) as n from fit_points group by all) t
  join (select scale, sum(abs(p-s))/sum(n) as ece from (select scale, len(list_filter({EDGES}, lambda e: e<=x)) as bin, sum(n*x) as p, sum(s) as s, sum(n) as n from fit_applied group by all) group by all) b on b.scale is not distinct from t.scale
  join (select scale, sum(abs(p-s))/sum(n) as ece from (select scale, len(list_filter({EDGES}, lambda e: e<=q)) as bin, sum(n*q) as p, sum(s) as s, sum(n) as n from fit_applied group by all) group by all) a on a.scale is not distinct from t.scale""",
)
def fits_per_scale(spark, sf):
    """The report of the fits of all scales and of the shared one (scale null)."""
    rows = _scaled(spark, sf).withColumn("scale", F.col("scale").cast("int"))
    _, report = calibration.fit_per_scale(rows, F.col("image_id") * 131 + F.col("patch_no") * 17, label="y")
    return rounded(report)


@query("src19_calibrator_file", ("patches",), "select scale, kind, n_rows, fitted from (values (64,'platt'),(128,'isotonic'),(null,'platt')) t(scale,kind), (select count(*) as n_rows, true as fitted from patches)")
def calibrator_file(spark, sf):
    path = tables.scratch_dir(spark, "calibrators")
    calibration.save(spark.createDataFrame(CALIBRATORS, calibration.SCHEMA), path)
    n = fx.patches(spark, sf).agg(F.count(F.lit(1))).scalar()
    return calibration.load(spark, path).select("scale", "kind", n.alias("n_rows"), "fitted")


# --- class names --------------------------------------------------------------------------

FIRST = ("Fake", "AI-generated", "deepfake", "click", "not_ai")
SECOND = ("real", "human", "Real photo", "genuine", "artificial", "view", "natural")
AI_LIST = "[" + ",".join(f"'{t}'" for t in labels.AI_TOKENS) + "]"
REAL_LIST = "[" + ",".join(f"'{t}'" for t in labels.REAL_TOKENS) + "]"
NORM = "regexp_replace(lower({c}),'[^a-z0-9]','','g')"
SIDE = "case when list_contains({ai},{n}) then 'ai' when list_contains({re},{n}) then 'real' end"
cte(
    "named_models",
    f"""select event_id, case when event_id%11=0 then (event_id%3)::int end as want_index, case when event_id%13=0 then 'human' end as want_name, a, b, {SIDE.format(ai=AI_LIST, re=REAL_LIST, n=NORM.format(c='a'))} as sa, {SIDE.format(ai=AI_LIST, re=REAL_LIST, n=NORM.format(c='b'))} as sb from
  (select event_id, ({list(FIRST)!r})[(event_id%5+1)::int] as a, ({list(SECOND)!r})[(event_id%7+1)::int] as b from events)""",
)


@query(
    "prj22_resolve_positive_class",
    ("named_models",),
    f"""select event_id, error, case when error is null then case when want_index is not null then [want_index] when want_name is not null then list_filter([case when {NORM.format(c='a')}=want_name then 0 end, case when {NORM.format(c='b')}=want_name then 1 end], lambda i: i is not null)
    else list_filter([case when sa='ai' then 0 end, case when sb='ai' then 1 end], lambda i: i is not null) end end as positive,
   case when error is null then case when want_index is not null then 'explicit index' when want_name is not null then 'explicit name' else 'token lists' end end as resolved_by from
  (select *, case when want_index is not null then case when want_index>1 then 'index is not one of the outputs' end when want_name is not null then case when {NORM.format(c='a')}<>want_name and {NORM.format(c='b')}<>want_name then 'name matches no label' end
    when sa is null or sb is null then 'unrecognised label' when sa<>'ai' and sb<>'ai' then 'no AI class' when sa<>'real' and sb<>'real' then 'no real class' end as error from named_models)""",
)
def resolve_positive_class(spark, sf):
    pick = lambda names, n: F.element_at(F.array(*[F.lit(v) for v in names]), (F.col("event_id") % n + 1).cast("int"))
    rows = fx.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 11 == 0, (F.col("event_id") % 3).cast("int")).alias("want_index"),
        F.when(F.col("event_id") % 13 == 0, "human").alias("want_name"),
        F.create_map(F.lit(0), pick(FIRST, 5), F.lit(1), pick(SECOND, 7)).alias("id2label"),
    )
    return labels.resolve_positive(rows, "event_id", "id2label", "want_index", "want_name")


@query(
    "prj23_sum_of_positive_classes",
    ("patches",),
    "select scale, image_id, patch_no, round(case scale when 64 then score*5e-1 when 128 then score else score*5e-1+score2*25e-2 end,6) as score from patches",
)
def sum_of_positive_classes(spark, sf):
    p = fx.patches(spark, sf)
    probs = p.select(
        "scale",
        "image_id",
        "patch_no",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("id"), (F.col("score") * 0.5).alias("p")),
                F.struct(F.lit(1).alias("id"), (F.col("score2") * 0.25).alias("p")),
                F.struct(F.lit(2).alias("id"), (F.col("score") * 0.5).alias("p")),
            )
        ).alias("c"),
    ).select("scale", "image_id", "patch_no", "c.id", "c.p")
    side = lambda *names: F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])
    id2label = F.when(F.col("scale") == 64, side("fake", "real", "human")).when(F.col("scale") == 128, side("fake", "real", "ai")).otherwise(side("gan", "sdxl", "real"))
    resolved = labels.resolve_positive(p.select("scale").distinct().withColumn("id2label", id2label), "scale", "id2label")
    return rounded(labels.positive_probability(probs, resolved, "scale", ["image_id", "patch_no"]))


# --- features -----------------------------------------------------------------------------


@query(
    "prj12_block_selection",
    ("feat",),
    "select sample_id, 32 as dim, round(features[33]::double,6) as first, round(features[64]::double,6) as last, 0 as start, 32 as stop from feat",
)
def block_selection(spark, sf):
    picked, kept = features.select_blocks(F.col("features"), FEATURE_BLOCKS, ["spectral"])
    _, dim, start, stop = kept[0]
    rows = fx.feat(spark, sf).withColumn("f", picked)
    return rounded(
        rows.select(
            "sample_id", F.lit(dim).alias("dim"), F.col("f")[0].cast("double").alias("first"), F.element_at("f", -1).cast("double").alias("last"), F.lit(start).alias("start"), F.lit(stop).alias("stop")
        )
    )


cte(
    "scaler",
    "select i, avg(v) as mean, stddev_pop(v)+1e-8 as std from (select generate_subscripts(features,1) as i, unnest(features)::double as v from feat where not is_aug) group by i",
    ("feat",),
)


@query("agg08_scaler_fit", ("scaler",), "select (i-1)::int as pos, round(mean,6) as mean, round(std,6) as std from scaler")
def scaler_fit(spark, sf):
    scaler = features.fit_scaler(fx.feat(spark, sf).where(~F.col("is_aug")))
    return rounded(scaler.select(F.posexplode(F.arrays_zip("mean", "std")).alias("pos", "s")).select("pos", "s.mean", "s.std"))


@query(
    "prj13_scaled_features",
    ("feat", "scaler"),
    "select sample_id, round((features[1]::double-a.mean)/a.std,5) as first, round((features[64]::double-b.mean)/b.std,5) as last from feat, scaler a, scaler b where a.i=1 and b.i=64",
)
def scaled_features(spark, sf):
    rows = fx.feat(spark, sf)
    scaled = features.apply_scaler(rows, features.fit_scaler(rows.where(~F.col("is_aug"))))
    return rounded(scaled.select("sample_id", F.col("features")[0].alias("first"), F.col("features")[63].alias("last")), 5)


@query(
    "agg09_class_weight",
    ("feat",),
    "select y, count(*) as n, round(sum(case when y=1 then w else 1 end),6) as total from feat, (select sum(1-y)/greatest(sum(y),1)::double as w from feat) group by y",
)
def class_weight(spark, sf):
    weighted = features.class_weight(fx.feat(spark, sf))
    return rounded(weighted.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total")))


# --- models -------------------------------------------------------------------------------


def separable(spark, sf):
    """The whole feature table, all 64 columns; nothing of it comes from the labels."""
    return fx.feat(spark, sf)


def train_val(spark, sf):
    rows = split_by_group(separable(spark, sf), "group_id", 0.25, (F.col("group_id") * 7919 + 17) % 10007)
    train, val = rows.where(~F.col("is_val")), rows.where("is_val")
    scaler = features.fit_scaler(train)
    return models.prepare(train, scaler), models.prepare(val, scaler), scaler


cte(
    "val_groups",
    """select group_id, r<=floor(n*25e-2) as is_val from (select group_id, row_number() over (order by (group_id*7919+17)%10007, group_id) as r, count(*) over () as n from (select distinct group_id from feat))""",
    ("feat",),
)
TREES = boosting.Settings(rounds=6, depth=3, step=0.3, check=3, patience=6)


def judged(scored, *keys):
    """What can be told of a model's metrics without the model: the rows judged, and that it ranks them better than chance."""
    return scored.select(*keys, F.col("n").cast("long").alias("n"), (F.col("auc") > 0.5).alias("beats_chance"))


def marked(spark, sf):
    return split_by_group(separable(spark, sf), "group_id", 0.25, (F.col("group_id") * 7919 + 17) % 10007)


@query("ml01_multilayer_perceptron", ("feat", "val_groups"), "select count(*) as n, true as beats_chance from feat join val_groups using (group_id) where is_val")
def multilayer_perceptron(spark, sf):
    """The stage of training with the best validation AUC."""
    train, val, _ = train_val(spark, sf)
    return judged(models.evaluate(models.score(models.fit_mlp(train, 64, (64, 32), 200, validation=val, stage=50), val)))


@query(
    "ml02_boosted_trees",
    ("feat", "val_groups"),
    "select count(*) as n, true as best_round_kept from feat join val_groups using (group_id) where is_val",
)
def boosted_trees(spark, sf):
    """Boosted trees that keep the round of the best validation AUC; what they keep scores as well as was seen then."""
    rows = marked(spark, sf)
    fitted = boosting.fit(rows, {"all": boosting.Model(~F.col("is_val"), F.col("is_val"))}, TREES)
    scored = models.evaluate(boosting.score(fitted, rows.where("is_val")))
    best = max(auc for _, _, auc in fitted.history)
    return scored.select(F.col("n").cast("long").alias("n"), (F.abs(F.col("auc") - F.lit(best)) < 1e-9).alias("best_round_kept"))


STUMP_CUTS = [round(-0.3 + 0.1 * i, 1) for i in range(7)]


@query(
    "srt02_top_features",
    ("feat",),
    f"""select (i-1)::int as position, round(max(gain),6) as gain from (select i, round(gl*gl/(hl+1)+gr*gr/(hr+1)-(gl+gr)*(gl+gr)/(hl+hr+1),9) as gain from
  (select i, c, sum(case when v<=c then w*(5e-1-y) else 0 end) as gl, sum(case when v<=c then w/4 else 0 end) as hl, sum(case when v>c then w*(5e-1-y) else 0 end) as gr, sum(case when v>c then w/4 else 0 end) as hr from
   (select generate_subscripts(features,1) as i, unnest(features)::double as v, y, case when y=1 then (select sum(1-y)/greatest(sum(y),1)::double from feat where not is_aug) else 1e0 end as w from feat where not is_aug),
   (select unnest({STUMP_CUTS!r}::double[]) as c) group by i, c) where hl>=1 and hr>=1) where gain>0 group by i order by gain desc, position limit 20""",
)
def top_features(spark, sf):
    """One stump for each column, all in one pass, and the columns whose stumps gain most."""
    rows = separable(spark, sf)
    stumps = {str(i): boosting.Model(~F.col("is_aug"), None, [i]) for i in range(64)}
    fitted = boosting.fit(rows, stumps, boosting.Settings(rounds=1, depth=1, subsample=1.0), cuts=[np.array(STUMP_CUTS)] * 64)
    return rounded(boosting.top_features(fitted, spark))


@query(
    "ml03_bundle_round_trip",
    ("feat",),
    """select count(*) as n, 0e0 as largest_difference, 'boosted_trees' as classifier from feat f join (select group_id, row_number() over (order by (group_id*7919+17)%10007, group_id) as r, count(*) over () as n
  from (select distinct group_id from feat)) g on g.group_id=f.group_id where r<=floor(n*25e-2)""",
)
def bundle_round_trip(spark, sf):
    train, val, scaler = train_val(spark, sf)
    model = models.fit_boosted_trees(train, 20, 6)
    path = tables.scratch_dir(spark, "bundle")
    models.save_bundle(model, scaler, {"classifier": "boosted_trees", "threshold": "0.5"}, path)
    again, _, meta = models.load_bundle(spark, path)
    before = models.score(model, val).select("sample_id", F.col("pred").alias("before"))
    after = models.score(again, val).select("sample_id", F.col("pred").alias("after"))
    return before.join(after, "sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("before") - F.col("after"))).alias("largest_difference")
    ).withColumn("classifier", F.lit(meta["classifier"]))


@query(
    "ml04_block_ablation",
    ("feat", "val_groups"),
    "select blocks, n_features, n, true as scored from (values ('low',32),('high',32),('low+high',64)) t(blocks,n_features), (select count(*) as n from feat join val_groups using (group_id) where is_val)",
)
def block_ablation(spark, sf):
    """A block may hold no signal, so no more than a defined AUC is asked of each subset."""
    blocks = [("low", 32), ("high", 32)]
    table = models.block_ablation(marked(spark, sf), blocks, [["low"], ["high"], ["low", "high"]], TREES, F.col("is_val"))
    return table.select("blocks", "n_features", F.col("n").cast("long").alias("n"), F.col("auc").between(0.0, 1.0).alias("scored"))


@query("ml05_leave_one_family_out", ("feat",), "select family as held_family, count(*) as n, true as scored from feat where not is_aug group by 1")
def leave_one_family_out(spark, sf):
    """A family may lie outside what the others teach, so no more than a defined AUC is asked of its scores."""
    folds = models.leave_one_family_out(marked(spark, sf), [0, 1, 2], TREES, F.col("is_val"))
    return folds.select("held_family", F.col("n").cast("long").alias("n"), F.col("auc").between(0.0, 1.0).alias("scored"))


@query(
    "ml06_batch_scoring",
    ("feat", "val_groups"),
    "select family, count(*) as n, 0e0 as largest_difference, true as inside from feat join val_groups using (group_id) where is_val group by 1",
)
def batch_scoring(spark, sf):
    """Stored trees score stored features: as the trees did before they were stored."""
    rows = marked(spark, sf)
    fitted = boosting.fit(rows, {"all": boosting.Model(~F.col("is_val"), F.col("is_val"))}, TREES)
    path = tables.scratch_dir(spark, "trees")
    boosting.save(fitted, spark, path)
    val = rows.where("is_val").select("sample_id", "family", "features")
    before = boosting.score(fitted, val).select("sample_id", "family", F.col("pred").alias("before"))
    after = boosting.score(boosting.load(spark, path), val).select("sample_id", "pred")
    return before.join(after, "sample_id").groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("before") - F.col("pred"))).alias("largest_difference"), F.bool_and(F.col("pred").between(0.0, 1.0)).alias("inside")
    )


@query("ml07_learnability_control", ("feat", "val_groups"), "select count(*) as n, true as beats_chance from feat join val_groups using (group_id) where is_val")
def learnability_control(spark, sf):
    train, val, _ = train_val(spark, sf)
    return judged(models.learnability(train, val))


# --- extension points ---------------------------------------------------------------------


def _mean_scorer():
    return lambda batch: np.array([float(np.mean(v)) + 0.5 for v in batch["features"]])


@query("udf01_pluggable_scorer", ("feat",), "select sample_id, round(list_avg(list_transform(features, lambda v: v::double))+5e-1,4) as score from feat")
def pluggable_scorer(spark, sf):
    rows = fx.feat(spark, sf).select("sample_id", "features")
    return rounded(udfs.score_patches(rows, _mean_scorer, ["sample_id"]), 4)


def _half_extractor():
    return lambda batch: np.stack([np.asarray(v)[:4] * 0.5 for v in batch["features"]])


@query("udf02_pluggable_extractor", ("feat",), "select sample_id, 4 as dim, round(features[1]::double*5e-1,6) as first from feat")
def pluggable_extractor(spark, sf):
    rows = fx.feat(spark, sf).select("sample_id", "features")
    out = udfs.extract_features(rows, _half_extractor, ["sample_id"])
    return rounded(out.select("sample_id", F.size("features").alias("dim"), F.col("features")[0].cast("double").alias("first")))


def _linear_predictor():
    weights = np.linspace(-1.0, 1.0, 64)
    return lambda batch: 1.0 / (1.0 + np.exp(-np.stack(batch["features"].to_numpy()).astype(float) @ weights))


@query(
    "udf03_foreign_predictor",
    ("feat",),
    "select sample_id, round(1/(1+exp(-z)),5) as score from (select sample_id, sum(v*(-1+2*(i-1)/63e0)) as z from (select sample_id, generate_subscripts(features,1) as i, unnest(features)::double as v from feat) group by 1)",
)
def foreign_predictor(spark, sf):
    """A model that is not a Spark model, loaded once per worker."""
    rows = fx.feat(spark, sf).select("sample_id", "features")
    return rounded(udfs.score_patches(rows, _linear_predictor, ["sample_id"]), 5)


@query("udf06_knots_per_scale", ("scale_y",), "select scale, count(distinct score) as n_scores, round(min(score),6) as lowest, round(max(score),6) as highest from scale_y group by scale")
def knots_per_scale(spark, sf):
    """The staircase thinned per scale; with few distinct scores every one stays a knot."""
    steps = _scaled(spark, sf).groupBy("scale", F.col("score").alias("x")).agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    knots = calibration.thin_knots(steps, ["scale"])
    return rounded(
        knots.select("scale", F.size("knots").cast("long").alias("n_scores"), F.col("knots")[0]["x"].alias("lowest"), F.element_at("knots", -1)["x"].alias("highest"))
    )


# --- bootstrap ----------------------------------------------------------------------------


cte("pairs", "select y, p_with as a, p_without as b, count(*) as n, min(id) % 2147483647 as k from arms group by 1,2,3", ("arms",))
cte(
    "drawn",
    """select y, a, b, n, r, (x+5e-1)/2147483647 as u from (select *, (x3*x3%2147483647*x1+k*45991+r*30323)%2147483647 as x from (select *, x1*x1%2147483647 as x3 from
   (select *, (x2*x2%2147483647*x0+k*40692+r*39373)%2147483647 as x1 from (select *, x0*x0%2147483647 as x2 from
    (select *, (k*48271+r*69621+1)%2147483647 as x0 from (select *, unnest(range(0,2000)) as r from pairs))))))""",
    ("pairs",),
)
cte(
    "poisson_steps",
    "select n, i, sum(exp(-n+i*ln(n)-lgamma(i+1))) over (partition by n order by i) as cdf from (select distinct n from pairs), (select unnest(range(0,80)) as i)",
    ("pairs",),
)
cte("weighted", "select d.y, d.a, d.b, d.r, d.u, count(p.i)::double as w from drawn d left join poisson_steps p on p.n=d.n and p.cdf<=d.u group by all", ("drawn", "poisson_steps"))
_REPLICATE = """(select r, sum(pos*(nb+neg/2))/nullif(sum(pos)*sum(neg),0) as auc from (select *, coalesce(sum(neg) over (partition by r order by s rows between unbounded preceding and 1 preceding),0) as nb
   from (select r, {s} as s, sum(w*y) as pos, sum(w*(1-y)) as neg from weighted group by 1,2)) group by 1)"""
cte("replicate_deltas", f"select p.r, p.auc-q.auc as delta from {_REPLICATE.format(s='a')} p join {_REPLICATE.format(s='b')} q on q.r=p.r where p.auc is not null and q.auc is not null", ("weighted",))


@query(
    "agg31_paired_bootstrap",
    ("arms", "replicate_deltas"),
    f"""select p.pos::double as n_positive, p.neg::double as n_negative, round(p.auc,6) as auc_with, round(q.auc,6) as auc_without, round(p.auc-q.auc,6) as delta, round(lo,6) as ci_low, round(hi,6) as ci_high, (lo>0 or hi<0) as significant
  from {auc_sql('arms', '', 'p_with')} p, {auc_sql('arms', '', 'p_without')} q, (select quantile_cont(delta,25e-3) as lo, quantile_cont(delta,975e-3) as hi from replicate_deltas)""",
)
def paired_bootstrap(spark, sf):
    return rounded(bootstrap.paired_auc_delta(fx.arms(spark, sf), "p_with", "p_without", "y", replicates=2000, key=F.col("id")))


# --- streams ------------------------------------------------------------------------------


def _stream(spark, sf, name):
    """A table as a stream. The path is a pattern, as a stream takes one for a file and for a folder of part files alike."""
    return spark.readStream.schema(fx.table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


@query("str01_score_on_arrival", ("feat",), "select sample_id, round(list_avg(list_transform(features, lambda v: v::double))+5e-1,4) as score from feat")
def score_on_arrival(spark, sf):
    """Vectors replayed as a stream, scored batch by batch by a pluggable model."""
    rows = _stream(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").alias("features"))
    out = tables.scratch_dir(spark, "arrivals")
    scorer = lambda batch: udfs.score_patches(batch, _mean_scorer, ["sample_id"])
    jobs.score_arriving(rows, scorer, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return rounded(spark.read.schema("sample_id bigint, score double").parquet(f"{out}/rows"), 4)


@query(
    "str02_running_evaluation",
    (),
    """with c as (select score as b, sum((k<>0)::int)::double as ai, sum((k=2)::int)::double as ta, sum((k=0)::int)::double as re from (select l_orderkey%3 as k, l_discount*1e1 as score from lineitem) group by 1),
  d as (select *, coalesce(sum(re) over (order by b rows between unbounded preceding and 1 preceding),0) as below from c)
  select round(sum(ai*(below+re/2))/(sum(ai)*sum(re)),6) as auc, round(sum(ta*(below+re/2))/(sum(ta)*sum(re)),6) as auc_tampered, (select round(avg((l_linenumber%4>0)::int),6) from lineitem where l_orderkey%3=0) as fp_rate, (select count(*) from lineitem) as n from d""",
)
def running_evaluation(spark, sf):
    """The numbers after the last micro-batch of a replayed table."""
    rows = _stream(spark, sf, "lineitem").select(
        F.when(F.col("l_orderkey") % 3 == 0, "real").when(F.col("l_orderkey") % 3 == 1, "synthetic").otherwise("tampered").alias("class"),
        (F.col("l_discount") * 10.0).alias("score"),
        (F.col("l_linenumber") % 4).alias("n_regions"),
    )
    out = tables.scratch_dir(spark, "running")

    def show(numbers, batch):
        numbers.coalesce(1).write.mode("overwrite").parquet(f"{out}/numbers")

    jobs.running_evaluation(rows, show, f"{out}/checkpoint").awaitTermination()
    return rounded(spark.read.parquet(f"{out}/numbers"))


@query(
    "str03_collapse_alarm",
    (),
    """select run, min(event_id) as alarm_epoch, max(streak) filter (streak=2)::int as streak from (select run, event_id, e-max(case when bad then 0 else e end) over (partition by run order by event_id) as streak from
  (select user_id::varchar as run, event_id, (value/5e2<2e-1 and ((event_id*7919+user_id)%100)/1e2<55e-2) as bad, row_number() over (partition by user_id order by event_id) as e from events)) where streak>=2 and event_id>=2 group by run""",
)
def collapse_alarm(spark, sf):
    log = _stream(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run"),
        F.col("event_id").alias("epoch"),
        ((F.col("event_id") * 7919 + F.col("user_id")) % 100 / F.lit(100.0)).alias("val_auc"),
        (F.col("value") / 500.0).alias("val_pred_std"),
    )
    out = tables.scratch_dir(spark, "alarms")

    def show(alarms, batch):
        alarms.write.mode("overwrite").parquet(f"{out}/alarms")

    jobs.collapse_alarms(log, show, f"{out}/checkpoint", 2, 2, std_below=0.2).awaitTermination()
    return spark.read.schema(jobs.ALARM_SCHEMA).parquet(f"{out}/alarms")
