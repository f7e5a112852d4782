"""Queries over windows, likelihood maps and raster operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from pixelwarrant import fixtures as fx
from pixelwarrant.functions import scalar
from pixelwarrant.operators import evaluation, grid, heatmap, ranks, windows
from pixelwarrant.plans.queries_metrics import auc_sql
from pixelwarrant.plans.registry import cte, query
from pixelwarrant.plans.rounding import rounded

SCALES = (2, 4)


def tiles_by_image(spark, sf):
    return grid.by_image(fx.tiles(spark, sf))


def tile_images(spark, sf):
    return fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("w"), F.lit(8).alias("h"))


def tile_windows(spark, sf):
    return windows.plan_windows(tile_images(spark, sf), SCALES, 0.5, floor=1)


ABSTAIN = 0.49


def tile_scores(spark, sf):
    """Mean heat of every window, from a scorer that gives no score to a coarse window below `ABSTAIN`: cells stay uncovered there."""
    scored = windows.window_means(tile_windows(spark, sf), fx.tiles(spark, sf), {"score": F.col("heat")})
    score = F.round("score", 12)
    return scored.withColumn("score", F.when((F.col("scale") == 2) | (score >= ABSTAIN), score))


def tile_blend(spark, sf):
    return heatmap.with_support(heatmap.blend_windows(grid.by_image(tile_scores(spark, sf))))


def tile_map(spark, sf):
    return heatmap.combine_scales(tile_blend(spark, sf), scales=SCALES)


cte(
    "tile_windows",
    """select i.image_id, s.scale, a.v as x0, b.v as y0, a.v+s.scale as x1, b.v+s.scale as y1 from (select distinct image_id from tiles) i,
  (values (2,1),(4,2)) s(scale,st), (select unnest(range(0,8)) as v) a, (select unnest(range(0,8)) as v) b where a.v%st=0 and b.v%st=0 and a.v+scale<=8 and b.v+scale<=8""",
    ("tiles",),
)
cte(
    "tile_scores",
    """select * replace (case when scale=2 or score>=49e-2 then score end as score) from (select w.image_id, w.scale, w.x0, w.y0, w.x1, w.y1, round(avg(t.heat),12) as score
  from tile_windows w join tiles t on t.image_id=w.image_id and t.x>=w.x0 and t.x<w.x1 and t.y>=w.y0 and t.y<w.y1 group by 1,2,3,4,5,6)""",
    ("tile_windows", "tiles"),
)
HANN = "(5e-1-5e-1*cos(2*pi()*(t.{a}-w.{a}0+1)/(w.scale+1))+1e-3)"
cte(
    "tile_blend",
    f"""select *, weight/max(weight) over (partition by image_id, scale) as support from (select t.image_id, w.scale, t.y, t.x, sum({HANN.format(a='y')}*{HANN.format(a='x')}*score)/greatest(sum({HANN.format(a='y')}*{HANN.format(a='x')}),1e-6) as heat,
  sum({HANN.format(a='y')}*{HANN.format(a='x')}) as weight from tile_scores w join tiles t on t.image_id=w.image_id and t.x>=w.x0 and t.x<w.x1 and t.y>=w.y0 and t.y<w.y1 where w.score is not null group by 1,2,3,4)""",
    ("tile_scores", "tiles"),
)
cte(
    "tile_map",
    """select image_id, y, x, max(heat) as heat, sum(support)/2 as support, sum(case scale when 2 then heat else 2*heat end)/sum(case scale when 2 then 1 else 2 end) as mean_heat,
  greatest(max(heat), case when count(heat)<2 then 5e-1 else 0 end) - least(min(heat), case when count(heat)<2 then 5e-1 else 1e9 end) as disagreement from tile_blend group by 1,2,3""",
    ("tile_blend",),
)


@query(
    "prj15_effective_scales",
    ("patches",),
    """select image_id, patch_no, list_transform(list_filter(list_zip(l, range(1,6)), lambda p: list_position(l,p[1])=p[2]), lambda p: p[1]) as scales from
  (select image_id, patch_no, list_transform([64,128,224,300,500], lambda s: greatest(8,least(s,least(w,h))::int)) as l from patches)""",
)
def effective_scales(spark, sf):
    scales = windows.effective_scales(F.col("w"), F.col("h"), (64, 128, 224, 300, 500))
    return fx.patches(spark, sf).select("image_id", "patch_no", scales.alias("scales"))


@query(
    "prj16_window_starts",
    ("patches",),
    """select image_id, patch_no, case when 224>=w then [0] else list_sort(list_distinct(list_concat(range(0,w::int-224+1,112),[w::int-224]))) end as starts from patches""",
)
def window_starts(spark, sf):
    starts = windows.starts(F.col("w").cast("int"), F.lit(224), F.lit(112))
    return fx.patches(spark, sf).select("image_id", "patch_no", F.sort_array(starts).alias("starts"))


PLAN_SQL = """select image_id, patch_no, scale, count(*) as n, sum(x0)::bigint as sx, sum(y0)::bigint as sy, max(x0+p)::int as right_edge, max(y0+p)::int as bottom_edge from
 (select image_id, patch_no, scale, p, y0, unnest(case when p>=w then [0] else list_distinct(list_concat(range(0,w-p+1,st),[w-p])) end) as x0 from
  (select image_id, patch_no, scale, w, p, st, unnest(case when p>=h then [0] else list_distinct(list_concat(range(0,h-p+1,st),[h-p])) end) as y0 from
   (select image_id, patch_no, w::int as w, h::int as h, scale, scale as p, greatest(1,round_even(scale*(1e0-4e-1),0)::int) as st from
     (select image_id, patch_no, w, h, unnest(list_distinct([least(224,least(w,h))::int, least(320,least(w,h))::int])) as scale from patches)))) group by 1,2,3"""


@query("prj17_window_plan", ("patches",), PLAN_SQL)
def window_plan(spark, sf):
    sized = fx.patches(spark, sf).select("image_id", "patch_no", "w", "h")
    plan = windows.plan_windows(sized, (224, 320), 0.4)
    return plan.groupBy("image_id", "patch_no", "scale").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("x0").alias("sx"),
        F.sum("y0").alias("sy"),
        F.max("x1").alias("right_edge"),
        F.max("y1").alias("bottom_edge"),
    )


@query("udf05_window_plan_table_function", ("tile_windows",), "select image_id, scale, x0, y0, x1, y1 from tile_windows")
def window_plan_function(spark, sf):
    from pixelwarrant.functions.udfs import register

    register(spark)
    tile_images(spark, sf).createOrReplaceTempView("pw_tile_images")
    return spark.sql(
        "select i.image_id, p.scale, p.x0, p.y0, p.x1, p.y1 from pw_tile_images i, lateral plan_windows(i.w, i.h, array(2, 4), 0.5D, 1) p"
    )


LABEL = "case when heat is null or support<35e-2 then 1 when heat>=55e-2 then 2 when heat<=45e-2 then 0 else 1 end"


def tile_label():
    return heatmap.three_way_label(F.round("heat", 9), F.round("support", 9), 0.45, 0.55, 0.35)


cte(
    "tile_labelled",
    "select *, " + LABEL.replace("heat", "h9").replace("support", "s9") + " as label from (select *, round(heat,9) as h9, round(support,9) as s9 from tile_map)",
    ("tile_map",),
)


@query("prj18_three_way_label", ("tile_labelled",), "select image_id, y, x, label::int as label from tile_labelled")
def three_way_label(spark, sf):
    return tile_map(spark, sf).select("image_id", "y", "x", tile_label().alias("label"))


@query(
    "prj19_label_by_centre",
    ("tile_windows", "tiles"),
    "select w.image_id, w.scale, w.x0, w.y0, w.x1, w.y1, (t.heat>=6e-1)::int as label from tile_windows w join tiles t on t.image_id=w.image_id and t.y=(w.y0+w.y1)//2 and t.x=(w.x0+w.x1)//2",
)
def label_by_centre(spark, sf):
    mask = fx.tiles(spark, sf).where(F.col("heat") >= 0.6).select("image_id", "y", "x")
    return windows.label_by_centre(tile_windows(spark, sf), mask)


cte(
    "coverage",
    """select w.image_id, w.scale, w.x0, w.y0, w.x1, w.y1, avg((t.heat>=6e-1)::int) as coverage from tile_windows w join tiles t on t.image_id=w.image_id and t.x>=w.x0 and t.x<w.x1 and t.y>=w.y0 and t.y<w.y1 group by 1,2,3,4,5,6""",
    ("tile_windows", "tiles"),
)


@query("join06_mask_coverage", ("coverage",), "select * replace (round(coverage,6) as coverage) from coverage")
def mask_coverage(spark, sf):
    return rounded(windows.mask_coverage(tile_windows(spark, sf), fx.tiles(spark, sf), F.col("heat") >= 0.6))


@query(
    "prj20_label_by_coverage",
    ("coverage",),
    "select image_id, scale, x0, y0, x1, y1, case when round(coverage,9)>=7e-1 then 1 else 0 end as label from coverage where round(coverage,9)>=7e-1 or round(coverage,9)<=5e-2",
)
def label_by_coverage(spark, sf):
    covered = windows.mask_coverage(tile_windows(spark, sf), fx.tiles(spark, sf), F.col("heat") >= 0.6)
    return windows.label_by_coverage(covered.withColumn("coverage", F.round("coverage", 9))).drop("coverage")


@query(
    "join04_cells_under_windows",
    ("tile_windows", "tiles"),
    """select t.image_id, t.y, t.x, w.scale, count(*) as n from tiles t join tile_windows w on t.image_id=w.image_id and t.x>=w.x0 and t.x<w.x1 and t.y>=w.y0 and t.y<w.y1 group by 1,2,3,4""",
)
def cells_under_windows(spark, sf):
    return windows.window_cells(tile_windows(spark, sf)).groupBy("image_id", "y", "x", "scale").agg(F.count(F.lit(1)).alias("n"))


@query(
    "join09_cascade",
    ("tile_windows", "tile_labelled"),
    """select image_id, scale, x0, y0, x1, y1 from tile_windows w where scale=4 or exists (select 1 from tile_labelled m where m.image_id=w.image_id and m.x>=w.x0 and m.x<w.x1 and m.y>=w.y0 and m.y<w.y1 and m.h9>=6e-1)""",
)
def cascade(spark, sf):
    plan = tile_windows(spark, sf)
    coarse = tile_map(spark, sf).withColumn("heat", F.round("heat", 9))
    return windows.cascade(plan.where("scale = 4"), plan.where("scale = 2"), coarse, 0.6)


@query("agg14_hann_blend", ("tile_blend",), "select image_id, scale, y, x, round(heat,6) as heat, round(weight,6) as weight from tile_blend")
def hann_blend(spark, sf):
    return rounded(heatmap.blend_windows(grid.by_image(tile_scores(spark, sf))))


@query("agg15_support", ("tile_blend",), "select image_id, scale, y, x, round(support,6) as support from tile_blend")
def support(spark, sf):
    return rounded(tile_blend(spark, sf).select("image_id", "scale", "y", "x", "support"))


@query(
    "agg16_combine_scales",
    ("tile_map",),
    "select image_id, y, x, round(heat,6) as max_heat, round(mean_heat,6) as mean_heat from tile_map",
)
def combine_scales(spark, sf):
    blended = tile_blend(spark, sf)
    top = heatmap.combine_scales(blended, scales=SCALES).select("image_id", "y", "x", F.col("heat").alias("max_heat"))
    mean = heatmap.combine_scales(blended, "mean", {2: 1.0, 4: 2.0}, scales=SCALES).select("image_id", "y", "x", F.col("heat").alias("mean_heat"))
    return rounded(top.join(mean, ["image_id", "y", "x"]))


@query("agg17_scale_disagreement", ("tile_map",), "select image_id, y, x, round(disagreement,6) as disagreement from tile_map")
def scale_disagreement(spark, sf):
    return rounded(tile_map(spark, sf).select("image_id", "y", "x", "disagreement"))


@query(
    "agg18_map_summary",
    ("tile_labelled",),
    """select image_id, round(avg(heat),6) as mean_score, round(max(heat),6) as max_score, round(quantile_cont(heat,95e-2),6) as p95_score, round(avg((label=2)::int),6) as frac_likely_ai,
  round(avg((label=1)::int),6) as frac_uncertain, round(avg((label=0)::int),6) as frac_likely_non_ai, round(avg(disagreement),6) as mean_scale_disagreement, round(avg(support),9) as mean_support
  from tile_labelled group by image_id""",
)
def map_summary(spark, sf):
    cells = tile_map(spark, sf).withColumn("label", tile_label())
    return rounded(heatmap.map_summary(cells), finer=("mean_support",))


@query(
    "udf07_smoothness_scorer",
    ("tile_windows", "tiles"),
    """select w.image_id, w.scale, w.x0, w.y0, w.x1, w.y1, round(greatest(0,least(1,1-(avg(case when t.x<w.x1-1 then t.dx end)+avg(case when t.y<w.y1-1 then t.dy end))/12e0)),6) as score from tile_windows w join
  (select *, abs(lead(v*4e1) over (partition by image_id,y order by x)-v*4e1) as dx, abs(lead(v*4e1) over (partition by image_id,x order by y)-v*4e1) as dy from tiles) t
  on t.image_id=w.image_id and t.x>=w.x0 and t.x<w.x1 and t.y>=w.y0 and t.y<w.y1 group by 1,2,3,4,5,6""",
)
def smoothness_scorer(spark, sf):
    return rounded(windows.smoothness_scores(tile_windows(spark, sf), fx.tiles(spark, sf), F.col("v") * 40.0))


@query(
    "win14_box_sums",
    ("tiles",),
    """select t.image_id, t.y, t.x, round(sum(s.v),6) as total from tiles t join tiles s on s.image_id=t.image_id and s.y between t.y-2 and t.y+2 and s.x between t.x-2 and t.x+2 group by 1,2,3""",
)
def box_sums(spark, sf):
    return rounded(grid.box_sum(tiles_by_image(spark, sf), {"total": F.col("v")}, 2).select("image_id", "y", "x", "total"))


# --- filters ------------------------------------------------------------------------------


def box_mean_sql(src: str, exprs: dict[str, str], r: int) -> str:
    cols = ", ".join(f"avg({e}) as {n}" for n, e in exprs.items())
    return f"(select t.image_id, t.y, t.x, {cols} from {src} t join {src} s on s.image_id=t.image_id and s.y between t.y-{r} and t.y+{r} and s.x between t.x-{r} and t.x+{r} group by 1,2,3)"


def mirrored_sql(i: str, repeat_edge: bool = False) -> str:
    if repeat_edge:
        return f"(case when ((({i})%16)+16)%16<8 then ((({i})%16)+16)%16 else 15-((({i})%16)+16)%16 end)"
    return f"(case when ((({i})%14)+14)%14<8 then ((({i})%14)+14)%14 else 14-((({i})%14)+14)%14 end)"


def gauss_sql(src: str, col: str, sigma: float, repeat_edge: bool = False, **how) -> str:
    taps = ",".join(f"({k},{w!r}::double)" for k, w in grid.gaussian_taps(sigma, **how))
    m = lambda axis: mirrored_sql(f"t.{axis}+k.k", repeat_edge)
    return f"""(with taps(k,w) as (values {taps}), hx as (select t.image_id, t.y, t.x, sum(k.w*s.{col}) as g from {src} t, taps k, {src} s where s.image_id=t.image_id and s.y=t.y and s.x={m('x')} group by 1,2,3)
  select t.image_id, t.y, t.x, sum(k.w*s.g) as g from hx t, taps k, hx s where s.image_id=t.image_id and s.x=t.x and s.y={m('y')} group by 1,2,3)"""


@query("grid01_hann_kernel", ("tile_windows",), """select image_id, scale, x0, y0, round(sum((5e-1-5e-1*cos(2*pi()*(i+1)/(scale+1))+1e-3)*(5e-1-5e-1*cos(2*pi()*(j+1)/(scale+1))+1e-3)),6) as mass
  from (select *, unnest(range(0,scale)) as i from tile_windows), lateral (select unnest(range(0,scale)) as j) group by 1,2,3,4""")
def hann_kernel(spark, sf):
    cells = windows.window_cells(tile_windows(spark, sf))
    weight = scalar.hann(F.col("y") - F.col("y0"), F.col("y1") - F.col("y0")) * scalar.hann(F.col("x") - F.col("x0"), F.col("x1") - F.col("x0"))
    return rounded(cells.groupBy("image_id", "scale", "x0", "y0").agg(F.sum(weight).alias("mass")))


@query("grid02_box_mean", ("tiles",), f"select image_id, y, x, round(m,6) as mean from {box_mean_sql('tiles', {'m': 's.v'}, 1)}")
def box_mean(spark, sf):
    return rounded(grid.box_mean(tiles_by_image(spark, sf), {"mean": F.col("v")}, 1).select("image_id", "y", "x", "mean"))


@query("grid03_gaussian_blur", ("tiles",), f"select image_id, y, x, round(g,6) as blur from {gauss_sql('tiles', 'v', 1.0)}")
def gaussian_blur(spark, sf):
    return rounded(grid.gaussian_blur(tiles_by_image(spark, sf), {"blur": "v"}, 1.0).select("image_id", "y", "x", "blur"))


def guided_sql(src: str, p: str, g: str, r: int) -> str:
    means = box_mean_sql(src, {"mg": f"s.{g}", "mp": f"s.{p}", "gg": f"s.{g}*s.{g}", "gp": f"s.{g}*s.{p}"}, r)
    lines = f"(select image_id, y, x, (gp-mg*mp)/(greatest(gg-mg*mg,0)+1e-3) as a, mp-(gp-mg*mp)/(greatest(gg-mg*mg,0)+1e-3)*mg as b from {means})"
    return f"(select m.image_id, m.y, m.x, ma*q.{g}+mb as s from {box_mean_sql(lines, {'ma': 's.a', 'mb': 's.b'}, r)} m join {src} q on q.image_id=m.image_id and q.y=m.y and q.x=m.x)"


@query("grid04_guided_filter", ("tiles",), f"select image_id, y, x, round(s,6) as smooth from {guided_sql('tiles', 'heat', 'v', 1)}")
def guided_filter(spark, sf):
    return rounded(grid.guided_filter(tiles_by_image(spark, sf), "heat", "v", 1).select("image_id", "y", "x", "smooth"))


cte(
    "holes",
    "select image_id, y, x, v, h, coalesce(h, avg(h) over (partition by image_id)) as f from (select *, case when (image_id+y*3+x)%11=0 then null else heat end as h from tiles)",
    ("tiles",),
)


@query(
    "grid05_smooth_with_gaps",
    ("holes",),
    f"""select t.image_id, t.y, t.x, case when t.h is not null then round(greatest(0,least(1,b.m)),6) end as box, case when t.h is not null then round(greatest(0,least(1,g.s)),6) end as guided,
  case when t.h is not null then round(greatest(0,least(1,z.g)),6) end as gaussian, round(t.h,6) as plain from holes t
  join {box_mean_sql('holes', {'m': 's.f'}, 2)} b on b.image_id=t.image_id and b.y=t.y and b.x=t.x join {guided_sql('holes', 'f', 'v', 2)} g on g.image_id=t.image_id and g.y=t.y and g.x=t.x
  join {gauss_sql('holes', 'f', 1.0)} z on z.image_id=t.image_id and z.y=t.y and z.x=t.x""",
)
def smooth_with_gaps(spark, sf):
    gap = (F.col("image_id") + F.col("y") * 3 + F.col("x")) % 11 == 0
    cells = tiles_by_image(spark, sf).withColumn("h", F.when(~gap, F.col("heat")))
    for method in ("box", "guided", "gaussian"):
        cells = grid.smooth_heatmap(cells, "h", "v", method, 2, out=method)
    cells = grid.smooth_heatmap(cells, "h", None, "none", out="plain")
    return rounded(cells.select("image_id", "y", "x", "box", "guided", "gaussian", "plain"))


def near_sql(src: str, expr: str, r: int, agg: str, name: str = "m") -> str:
    return f"(select t.image_id, t.y, t.x, {agg}({expr}) as {name} from {src} t join {src} s on s.image_id=t.image_id and s.y between t.y-{r} and t.y+{r} and s.x between t.x-{r} and t.x+{r} group by 1,2,3)"


cte("tile_mask", "select *, heat>=6e-1 as on_ from tiles", ("tiles",))
cte(
    "tile_morph",
    f"""select t.image_id, t.y, t.x, t.on_, t.v, t.heat, d.m as dilated, e.m as eroded, c.m as closed, t.on_ and not e.m as rim, d2.m and not t.on_ as ring from tile_mask t
  join {near_sql('tile_mask', 's.on_', 1, 'bool_or')} d on d.image_id=t.image_id and d.y=t.y and d.x=t.x join {near_sql('tile_mask', 's.on_', 1, 'bool_and')} e on e.image_id=t.image_id and e.y=t.y and e.x=t.x
  join {near_sql(near_sql('tile_mask', 's.on_', 1, 'bool_or'), 's.m', 1, 'bool_and')} c on c.image_id=t.image_id and c.y=t.y and c.x=t.x
  join {near_sql('tile_mask', 's.on_', 2, 'bool_or')} d2 on d2.image_id=t.image_id and d2.y=t.y and d2.x=t.x""",
    ("tile_mask",),
)


def tile_mask(spark, sf):
    return tiles_by_image(spark, sf).withColumn("on", F.col("heat") >= 0.6)


def tile_morph(spark, sf):
    m = grid.dilate(tile_mask(spark, sf), "on", 1, "dilated")
    m = grid.erode(m, "on", 1, "eroded")
    m = grid.close(m, "on", 1, "closed")
    return grid.ring(grid.rim(m, "on"), "on", 2)


@query("grid06_morphology", ("tile_morph",), "select image_id, y, x, dilated, eroded, closed, rim, ring from tile_morph")
def morphology(spark, sf):
    return tile_morph(spark, sf).select("image_id", "y", "x", "dilated", "eroded", "closed", "rim", "ring")


GRAD = """(select *, sqrt(gx*gx+gy*gy) as g from (select *, case when lx is null then rx-heat when rx is null then heat-lx else (rx-lx)/2 end as gx, case when ly is null then ry-heat when ry is null then heat-ly else (ry-ly)/2 end as gy from
  (select *, lag(heat) over (partition by image_id,y order by x) as lx, lead(heat) over (partition by image_id,y order by x) as rx, lag(heat) over (partition by image_id,x order by y) as ly, lead(heat) over (partition by image_id,x order by y) as ry from tiles)))"""


@query("grid07_gradient_magnitude", ("tiles",), f"select image_id, y, x, round(g,6) as gradient from {GRAD}")
def gradient(spark, sf):
    return rounded(grid.gradient(tiles_by_image(spark, sf), "heat").select("image_id", "y", "x", "gradient"))


@query("win16_central_differences", ("tiles",), f"select image_id, y, x, round(abs(gx),6) as gx_size, round(abs(gy),6) as gy_size from {GRAD}")
def central_differences(spark, sf):
    from pyspark.sql import Window

    def slope(line, pos):
        w = Window.partitionBy("image_id", line).orderBy(pos)
        a, b, h = F.lag("heat").over(w), F.lead("heat").over(w), F.col("heat")
        return F.abs(F.when(a.isNull(), b - h).when(b.isNull(), h - a).otherwise((b - a) / 2))

    return rounded(tiles_by_image(spark, sf).select("image_id", "y", "x", slope("y", "x").alias("gx_size"), slope("x", "y").alias("gy_size")))


cte("tile_grow_label", "select image_id, y, x, heat, case when heat>=6e-1 then 2 when heat<=45e-2 then 0 else 1 end as label from tiles", ("tiles",))
GROWN = f"""(select t.image_id, t.y, t.x, t.heat, t.label, d.m and t.label<>0 as grown from tile_grow_label t join {near_sql('tile_grow_label', 's.label=2', 1, 'bool_or')} d on d.image_id=t.image_id and d.y=t.y and d.x=t.x)"""
cte(
    "grown_mask",
    f"""select g.image_id, g.y, g.x, g.heat, g.label, c.m and g.label<>0 as grown from {GROWN} g join {near_sql(near_sql(GROWN, 's.grown', 1, 'bool_or'), 's.m', 1, 'bool_and')} c on c.image_id=g.image_id and c.y=g.y and c.x=g.x""",
    ("tile_grow_label",),
)


@query("grid08_grow_into_uncertain", ("grown_mask",), "select image_id, y, x, grown from grown_mask")
def grow_into_uncertain(spark, sf):
    from pixelwarrant.operators import regions

    labelled = tiles_by_image(spark, sf).withColumn("label", heatmap.three_way_label(F.col("heat"), F.lit(1.0), 0.45, 0.6))
    return regions.grown_mask(labelled, 1, 1).select("image_id", "y", "x", "grown")


@query("grid10_residual", ("tiles",), f"select t.image_id, t.y, t.x, round(t.v-g.g,6) as res from tiles t join {gauss_sql('tiles', 'v', 1.0)} g on g.image_id=t.image_id and g.y=t.y and g.x=t.x")
def residual(spark, sf):
    return rounded(grid.residual(tiles_by_image(spark, sf), "v", "res", 1.0).select("image_id", "y", "x", "res"))


@query("grid11_local_variance", ("tiles",), f"select image_id, y, x, round(greatest(0,mm-m*m),6) as local_var from {box_mean_sql('tiles', {'m': 's.v', 'mm': 's.v*s.v'}, 2)}")
def local_variance(spark, sf):
    return rounded(grid.local_variance(tiles_by_image(spark, sf), "v", 2).select("image_id", "y", "x", "local_var"))


@query(
    "grid13_nearest_resample",
    ("tiles",),
    "select t.image_id, yy as y, xx as x, round(t.v,6) as v from (select unnest(range(0,13)) as yy), (select unnest(range(0,5)) as xx), tiles t where t.y=floor((yy+5e-1)*8/13)::int and t.x=floor((xx+5e-1)*8/5)::int",
)
def nearest_resample(spark, sf):
    cells = fx.tiles(spark, sf).select("image_id", "y", "x", "v")
    return rounded(grid.resample_nearest(cells, F.lit(8), F.lit(8), F.lit(5), F.lit(13)).select("image_id", "y", "x", "v"))


def bilinear_sql(src: str, col: str, n_out: int) -> str:
    step = 8 / n_out
    spread = max(step, 1.0)

    def taps() -> str:
        rows = []
        for i in range(n_out):
            c = (i + 0.5) * step
            lo, hi = max(0, int(c - spread + 0.5)), min(8, int(c + spread + 0.5))
            ws = [max(0.0, 1 - abs((j + 0.5 - c) / spread)) for j in range(lo, hi)]
            rows += [f"({i},{j},{w / sum(ws)!r}::double)" for j, w in zip(range(lo, hi), ws)]
        return ",".join(rows)

    return f"""(with taps(i,j,w) as (values {taps()}), hx as (select s.image_id, s.y, k.i as x, sum(k.w*s.{col}) as g from {src} s join taps k on k.j=s.x group by 1,2,3)
  select s.image_id, k.i as y, s.x, sum(k.w*s.g) as g from hx s join taps k on k.j=s.y group by 1,2,3)"""


@query("grid27_bilinear_resample", ("tiles",), f"select image_id, y, x, round(g,6) as v, 'down' as way from {bilinear_sql('tiles', 'v', 3)} union all select image_id, y, x, round(g,6), 'up' from {bilinear_sql('tiles', 'v', 11)}")
def bilinear_resample(spark, sf):
    cells = fx.tiles(spark, sf)
    down = grid.resample_bilinear(cells, ["v"], F.lit(3), F.lit(3)).withColumn("way", F.lit("down"))
    up = grid.resample_bilinear(cells, ["v"], F.lit(11), F.lit(11)).withColumn("way", F.lit("up"))
    return rounded(down.unionByName(up).select("image_id", "y", "x", "v", "way"))


@query("grid25_channel_normalise", ("tiles",), f"select image_id, y, x, round((g-485e-3)/229e-3,6) as v from {bilinear_sql('tiles', 'v', 4)}")
def channel_normalise(spark, sf):
    small = grid.resample_bilinear(tiles_by_image(spark, sf), ["v"], F.lit(4), F.lit(4))
    return rounded(grid.normalise_channels(small, {"v": (0.485, 0.229)}).select("image_id", "y", "x", "v"))


@query(
    "grid28_box_iou",
    ("patches",),
    """select image_id, patch_no, round(i/(w*h+100*120-i)::double,6) as iou from (select *, greatest(0,least(w,150)-greatest(0,50))*greatest(0,least(h,160)-greatest(0,40)) as i from patches)""",
)
def box_iou(spark, sf):
    a = F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("w").alias("x1"), F.col("h").alias("y1"))
    b = F.struct(F.lit(50).alias("x0"), F.lit(40).alias("y0"), F.lit(150).alias("x1"), F.lit(160).alias("y1"))
    return rounded(fx.patches(spark, sf).select("image_id", "patch_no", scalar.box_iou(a, b).alias("iou")))


STRAIGHT = """(select sum(case when len>=5 then len else 0 end) as s, sum(len) as c, image_id from (select image_id, {line}, i, count(*) as len from (select image_id, {line}, {pos}-row_number() over (partition by image_id,{line} order by {pos}) as i from tile_morph where rim) group by 1,2,3) group by image_id)"""


@query(
    "win15_straight_rim_runs",
    ("tile_morph",),
    f"select a.image_id, round(least(1,(a.s+b.s)/(a.c+b.c)::double),6) as edge_straightness, a.c::bigint as rim_cells from {STRAIGHT.format(line='y', pos='x')} a join {STRAIGHT.format(line='x', pos='y')} b on b.image_id=a.image_id",
)
def straight_rim_runs(spark, sf):
    return rounded(grid.straight_cells(grid.rim(tile_mask(spark, sf), "on"), "rim"))


@query(
    "agg21_perimeter",
    ("tile_mask",),
    """select image_id, sum(4-coalesce(l,0)-coalesce(r,0)-coalesce(u,0)-coalesce(d,0))::bigint as perimeter, count(*) as cells from (select *, lag(on_::int) over (partition by image_id,y order by x) as l, lead(on_::int) over (partition by image_id,y order by x) as r,
  lag(on_::int) over (partition by image_id,x order by y) as u, lead(on_::int) over (partition by image_id,x order by y) as d from tile_mask) where on_ group by image_id""",
)
def perimeter(spark, sf):
    walked = grid.perimeter(tile_mask(spark, sf), "on").where("on")
    return walked.groupBy("image_id").agg(F.sum("exposed").alias("perimeter"), F.count(F.lit(1)).alias("cells"))


@query(
    "agg22_mask_metrics",
    ("tiles",),
    """select image_id, round(coalesce(i/nullif(u,0),0),6) as iou, round(coalesce(i/nullif(p,0),0),6) as precision, round(coalesce(i/nullif(t,0),0),6) as recall, round(coalesce(2*i/nullif(p+t,0),0),6) as f1,
  round(p/n,6) as pred_area_frac, round(t/n,6) as true_area_frac from (select image_id, sum((heat>=6e-1 and v>=15e-2)::int)::double as i, sum((heat>=6e-1 or v>=15e-2)::int)::double as u, sum((heat>=6e-1)::int)::double as p, sum((v>=15e-2)::int)::double as t, count(*)::double as n from tiles group by image_id)""",
)
def mask_metrics(spark, sf):
    from pixelwarrant.operators import regions

    return rounded(regions.mask_metrics(fx.tiles(spark, sf), F.col("heat") >= 0.6, F.col("v") >= 0.15))


@query(
    "agg35_map_reductions",
    ("tiles",),
    """select image_id, unnest(['max','p99','p95','p90','mean','frac_above_0.5','frac_above_0.6','frac_above_0.7','frac_above_0.75','frac_above_0.8','frac_above_0.9']) as reduction,
  unnest([round(max(heat),6),round(quantile_cont(heat,99e-2),6),round(quantile_cont(heat,95e-2),6),round(quantile_cont(heat,9e-1),6),round(avg(heat),6),round(avg((heat>=5e-1)::int),6),round(avg((heat>=6e-1)::int),6),
   round(avg((heat>=7e-1)::int),6),round(avg((heat>=75e-2)::int),6),round(avg((heat>=8e-1)::int),6),round(avg((heat>=9e-1)::int),6)]) as score from tiles group by image_id""",
)
def map_reductions(spark, sf):
    return rounded(evaluation.map_reductions(fx.tiles(spark, sf), ["image_id"]))


cte("tile_truth", "select image_id, heat, (v*v>2e-2)::int as y from tiles", ("tiles",))


@query(
    "agg45_map_auc",
    ("tile_truth",),
    f"select count(*) as n, round(avg(auc),6) as mean_pixel_auc from {auc_sql('tile_truth', 'image_id', 'heat')} where pos>=10 and neg>=10",
)
def map_auc(spark, sf):
    cells = fx.tiles(spark, sf).withColumn("inside", (F.col("v") * F.col("v") > 0.02).cast("int"))
    per_image = ranks.auc(cells, ["image_id"], "heat", "inside", bounded=True)
    usable = per_image.where((F.col("pos") >= 10) & (F.col("neg") >= 10))
    return rounded(usable.agg(F.count(F.lit(1)).alias("n"), F.avg("auc").alias("mean_pixel_auc")))
