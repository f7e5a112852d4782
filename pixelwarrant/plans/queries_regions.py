"""Queries over regions of the tile maps."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pixelwarrant import fixtures as fx
from pixelwarrant.operators import components as cc
from pixelwarrant.operators import evaluation, heatmap, regions
from pixelwarrant.plans.queries_grid import GRAD, SCALES, tile_map, tiles_by_image
from pixelwarrant.plans.queries_metrics import auc_sql, matched_sql
from pixelwarrant.plans.registry import cte, query
from pixelwarrant.plans.rounding import rounded
from pixelwarrant.session import durable

SETTINGS = dict(min_area_frac=0.03, grow=1, close_radius=1, halo=2, ring=2)
KEPT = 8  # of the regions of an image, where only the strongest are wanted


def tile_cells(spark, sf, tiles=None):
    """The raw tile heat as the map, with support and per-scale heat from the blended windows."""
    blended = tile_map(spark, sf).select(
        "image_id", "y", "x", F.round("support", 9).alias("support"), F.round("disagreement", 9).alias("disagreement"), "per_scale"
    )
    cells = (fx.tiles(spark, sf) if tiles is None else tiles).join(blended, ["image_id", "y", "x"])
    return cells.withColumn("label", heatmap.three_way_label(F.col("heat"), F.lit(1.0), 0.45, 0.6))


def tile_regions(spark, sf):
    return regions.extract_regions(tile_cells(spark, sf), SCALES, **SETTINGS)


cte(
    "components_reach",
    """select image_id, y, x, y*8+x as root from grown_mask where grown union
  select m.image_id, m.y, m.x, r.root from components_reach r join (select * from grown_mask where grown) m on m.image_id=r.image_id and abs(m.y-r.y)<=1 and abs(m.x-r.x)<=1""",
    ("grown_mask",),
)
cte(
    "components",
    "select *, dense_rank() over (partition by image_id order by root) as component from (select image_id, y, x, min(root) as root from components_reach group by 1,2,3)",
    ("components_reach",),
)
cte(
    "region_base",
    """select *, row_number() over (partition by image_id order by round(area_frac*mean_score,12) desc, component) as region_id from
  (select c.image_id, c.component, count(*) as area_px, count(*)/64e0 as area_frac, min(c.x) as x0, min(c.y) as y0, max(c.x)+1 as x1, max(c.y)+1 as y1, avg(c.x) as cx, avg(c.y) as cy,
    avg(t.heat) as mean_score, max(t.heat) as max_score, quantile_cont(t.heat,9e-1) as p90_score, stddev_pop(t.heat) as heat_std, avg(b2.heat) as fine, avg(b4.heat) as coarse,
    avg(round(m.disagreement,9)) as scale_disagreement, avg(round(m.support,9)) as support from components c join tiles t on t.image_id=c.image_id and t.y=c.y and t.x=c.x
    join tile_map m on m.image_id=c.image_id and m.y=c.y and m.x=c.x left join tile_blend b2 on b2.image_id=c.image_id and b2.y=c.y and b2.x=c.x and b2.scale=2
    left join tile_blend b4 on b4.image_id=c.image_id and b4.y=c.y and b4.x=c.x and b4.scale=4 group by 1,2) where area_frac>=3e-2""",
    ("components", "tiles", "tile_map", "tile_blend"),
)
cte("region_kept", "select * from region_base", ("region_base",))
cte(
    "region_cells",
    "select k.image_id, k.region_id, c.y, c.x from region_kept k join components c on c.image_id=k.image_id and c.component=k.component",
    ("region_kept", "components"),
)
cte(
    "region_local",
    """select f.image_id, f.region_id, f.y, f.x, f.i=1 as inside, f.i=1 and bool_or(n.i=0) filter (abs(n.y-f.y)<=1 and abs(n.x-f.x)<=1) as rim,
  f.i=0 and bool_or(n.i=1) as halo, case when f.i=1 then 4-count(*) filter (n.i=1 and abs(n.y-f.y)+abs(n.x-f.x)=1) else 0 end as exposed from
  (select k.image_id, k.region_id, t.y, t.x, (c.y is not null)::int as i from region_kept k join tiles t on t.image_id=k.image_id left join region_cells c on c.image_id=k.image_id and c.region_id=k.region_id and c.y=t.y and c.x=t.x) f
  join (select k.image_id, k.region_id, t.y, t.x, (c.y is not null)::int as i from region_kept k join tiles t on t.image_id=k.image_id left join region_cells c on c.image_id=k.image_id and c.region_id=k.region_id and c.y=t.y and c.x=t.x) n
   on n.image_id=f.image_id and n.region_id=f.region_id and abs(n.y-f.y)<=2 and abs(n.x-f.x)<=2 group by f.image_id, f.region_id, f.y, f.x, f.i""",
    ("region_kept", "region_cells", "tiles"),
)
cte("tile_gradient", f"select image_id, y, x, g from {GRAD}", ("tiles",))
cte(
    "region_rows",
    """select k.*, area_px/((x1-x0)*(y1-y0))::double as fill_ratio, (x0=0 or y0=0 or x1=8 or y1=8) as touches_border, s.boundary_sharpness, s.perimeter, s.uncertain_halo_frac,
  coalesce(4*pi()*area_px/nullif(s.perimeter*s.perimeter,0),0) as compactness from region_kept k join
  (select l.image_id, l.region_id, coalesce(avg(g.g) filter (l.rim),0) as boundary_sharpness, sum(l.exposed)::bigint as perimeter, coalesce(avg((q.label=1)::int) filter (l.halo),0) as uncertain_halo_frac
   from region_local l join tile_gradient g on g.image_id=l.image_id and g.y=l.y and g.x=l.x join tile_grow_label q on q.image_id=l.image_id and q.y=l.y and q.x=l.x group by 1,2) s
  on s.image_id=k.image_id and s.region_id=k.region_id""",
    ("region_kept", "region_local", "tile_gradient", "tile_grow_label"),
)


@query("grid09_connected_components", ("components",), "select image_id, y, x, component::int as component from components")
def connected_components(spark, sf):
    grown = regions.grown_mask(tile_labels(spark, sf), 1, 1)
    return cc.label_components(grown, "grown")


def tile_labels(spark, sf):
    return tiles_by_image(spark, sf).withColumn("label", heatmap.three_way_label(F.col("heat"), F.lit(1.0), 0.45, 0.6))


@query(
    "agg19_region_descriptors",
    ("region_rows",),
    """select image_id, region_id, area_px, round(area_frac,6) as area_frac, x0, y0, x1, y1, round(cx,6) as centroid_x, round(cy,6) as centroid_y, round(mean_score,6) as mean_score, round(max_score,6) as max_score,
  round(p90_score,6) as p90_score, round(fine,6) as fine, round(coarse,6) as coarse, round(scale_disagreement,6) as scale_disagreement, round(support,6) as support, round(fill_ratio,6) as fill_ratio, touches_border,
  round(uncertain_halo_frac,6) as uncertain_halo_frac, round(compactness,6) as compactness from region_rows""",
)
def region_descriptors(spark, sf):
    found, *_ = tile_regions(spark, sf)
    return rounded(
        found.select(
            "image_id",
            "region_id",
            "area_px",
            "area_frac",
            "bbox.x0",
            "bbox.y0",
            "bbox.x1",
            "bbox.y1",
            "centroid_x",
            "centroid_y",
            "mean_score",
            "max_score",
            "p90_score",
            F.col("scale_profile")[2].alias("fine"),
            F.col("scale_profile")[4].alias("coarse"),
            "scale_disagreement",
            "support",
            "fill_ratio",
            "touches_border",
            "uncertain_halo_frac",
            "compactness",
        )
    )


@query("agg20_boundary_sharpness", ("region_rows",), "select image_id, region_id, round(boundary_sharpness,6) as boundary_sharpness, perimeter from region_rows")
def boundary_sharpness(spark, sf):
    found, *_ = tile_regions(spark, sf)
    return rounded(found.select("image_id", "region_id", "boundary_sharpness", "perimeter"))


@query(
    "win10_region_rank",
    ("region_base",),
    "select * from (select image_id, region_id, round(area_frac*mean_score,6) as mass, greatest(0, count(*) over (partition by image_id)-8)::bigint as left_out from region_base) where region_id<=8",
)
def region_rank(spark, sf):
    """The strongest regions of each image, and how many come after them."""
    found, *_ = tile_regions(spark, sf)
    count = F.count(F.lit(1)).over(Window.partitionBy("image_id"))
    ranked = found.select("image_id", "region_id", (F.col("area_frac") * F.col("mean_score")).alias("mass"), F.greatest(F.lit(0), count - KEPT).alias("left_out"))
    return rounded(ranked.where(F.col("region_id") <= KEPT))


@query(
    "join14_region_measurements",
    ("region_cells", "tiles"),
    "select r.image_id, r.region_id, round(avg(t.v),6) as mean_v, round(min(t.heat),6) as min_heat, count(*) as n from region_cells r join tiles t on t.image_id=r.image_id and t.y=r.y and t.x=r.x group by 1,2",
)
def region_measurements(spark, sf):
    _, members, *_ = tile_regions(spark, sf)
    joined = members.join(fx.tiles(spark, sf), ["image_id", "y", "x"])
    return rounded(joined.groupBy("image_id", "region_id").agg(F.avg("v").alias("mean_v"), F.min("heat").alias("min_heat"), F.count(F.lit(1)).alias("n")))


@query(
    "agg23_union_mask",
    ("region_cells",),
    """select c.image_id, yy as y, xx as x from (select distinct image_id, y, x from region_cells) c, (select unnest(range(0,12)) as yy), (select unnest(range(0,20)) as xx)
  where c.y=floor((yy+5e-1)*8/12)::int and c.x=floor((xx+5e-1)*8/20)::int""",
)
def union_mask(spark, sf):
    _, members, *_ = tile_regions(spark, sf)
    return regions.predicted_mask(members, F.lit(8), F.lit(8), F.lit(20), F.lit(12)).select("image_id", "y", "x")


FACES_SQL = "select vec_id as image_id, (vec_id%5)::int as x0, (vec_id%3)::int as y0, (vec_id%5+4)::int as x1, (vec_id%3+5)::int as y1 from embeddings where vec_id%2=0"
cte("faces", FACES_SQL)


def faces(spark, sf):
    """One made-up face box on every second image."""
    v = F.col("vec_id")
    return fx.table(spark, sf, "embeddings").where(v % 2 == 0).select(
        v.alias("image_id"),
        (v % 5).cast("int").alias("x0"),
        (v % 3).cast("int").alias("y0"),
        (v % 5 + 4).cast("int").alias("x1"),
        (v % 3 + 5).cast("int").alias("y1"),
    )


cte(
    "region_faces",
    """select r.image_id, r.region_id, f.x0, f.y0, f.x1, f.y1, count(*)/max(k.area_px)::double as face_overlap from region_cells r join faces f on f.image_id=r.image_id and r.x>=f.x0 and r.x<f.x1 and r.y>=f.y0 and r.y<f.y1
  join region_kept k on k.image_id=r.image_id and k.region_id=r.region_id group by 1,2,3,4,5,6 having count(*)/max(k.area_px)::double>=35e-2""",
    ("region_cells", "region_kept", "faces"),
)


@query("join05_region_face_overlap", ("region_faces",), "select image_id, region_id, x0, y0, x1, y1, round(face_overlap,6) as face_overlap from region_faces")
def region_face_overlap(spark, sf):
    found, members, *_ = tile_regions(spark, sf)
    matched = regions.match_faces(found, members, faces(spark, sf))
    return rounded(matched.select("image_id", "region_id", "face.*", "face_overlap"))


for _cut in (50, 60, 70, 75, 80, 90):
    cte(
        f"components_hot{_cut}",
        f"""select image_id, y, x, y*8+x as root from tiles where heat>={_cut}e-2 union
  select m.image_id, m.y, m.x, r.root from components_hot{_cut} r join (select * from tiles where heat>={_cut}e-2) m on m.image_id=r.image_id and abs(m.y-r.y)<=1 and abs(m.x-r.x)<=1""",
        ("tiles",),
    )
    cte(
        f"best_hot{_cut}",
        f"""select image_id, max(m) as best from (select c.image_id, c.root, avg(t.heat) as m from (select image_id, y, x, min(root) as root from components_hot{_cut} group by 1,2,3) c join tiles t on t.image_id=c.image_id and t.y=c.y and t.x=c.x
  group by 1,2 having count(*)/64e0>=4e-2) group by 1""",
        (f"components_hot{_cut}", "tiles"),
    )


@query(
    "agg36_region_evidence",
    ("best_hot60", "best_hot70"),
    "select i.image_id, round(coalesce(a.best,0),6) as hi60, round(coalesce(b.best,0),6) as hi70 from (select distinct image_id from tiles) i left join best_hot60 a on a.image_id=i.image_id left join best_hot70 b on b.image_id=i.image_id",
)
def region_evidence(spark, sf):
    cells = fx.tiles(spark, sf)
    return rounded(
        regions.region_evidence(cells, 0.6, 0.04)
        .withColumnRenamed("score", "hi60")
        .join(regions.region_evidence(cells, 0.7, 0.04).withColumnRenamed("score", "hi70"), "image_id")
    )


# --- decision sweep: every way to make one score of a map ------------------------------------

CUTS, AREAS = (0.5, 0.6, 0.7, 0.75, 0.8, 0.9), (0.002, 0.01, 0.04)
for _cut in CUTS:
    _hot = f"components_hot{round(_cut * 100)}"
    cte(
        f"means_hot{round(_cut * 100)}",
        f"select c.image_id, c.root, avg(t.heat) as m, count(*)/64e0 as area from (select image_id, y, x, min(root) as root from {_hot} group by 1,2,3) c join tiles t on t.image_id=c.image_id and t.y=c.y and t.x=c.x group by 1,2",
        (_hot, "tiles"),
    )
_WAYS = [("max", "max(heat)"), ("p99", "quantile_cont(heat,99e-2)"), ("p95", "quantile_cont(heat,95e-2)"), ("p90", "quantile_cont(heat,9e-1)"), ("mean", "avg(heat)")]
_WAYS += [(f"frac_above_{c}", f"avg((heat>={c!r}::double)::int)") for c in CUTS]
cte(
    "reduced",
    "select r.image_id, case r.image_id%3 when 0 then 'real' when 1 then 'synthetic' else 'tampered' end as class, (r.image_id%3<>0)::int as y, r.reduction, round(r.score,9) as score from (select vec_id as image_id, 'whole_image_only' as reduction, label/9e0 as score from embeddings union all "
    + " union all ".join(f"select image_id, '{n}', {e} from tiles group by 1" for n, e in _WAYS)
    + "".join(
        f" union all select i.image_id, 'region_hi{c}_area{a}', coalesce(max(m.m) filter (m.area>={a!r}::double),0) from (select distinct image_id from tiles) i left join means_hot{round(c * 100)} m on m.image_id=i.image_id group by 1"
        for c in CUTS
        for a in AREAS
    )
    + ") r",
    ("tiles", *[f"means_hot{round(c * 100)}" for c in CUTS]),
)


@query(
    "agg37_decision_sweep",
    ("reduced",),
    f"""select row_number() over (order by round(a.auc,9) desc, a.reduction)::int as place, a.reduction, round(a.auc,6) as auc_real_vs_ai, round(s.auc,6) as auc_real_vs_fully_ai, round(t.auc,6) as auc_real_vs_partially_ai,
  round(m.false_positive_rate,6) as fpr_at_80_recall from {auc_sql('reduced', 'reduction')} a
  join {auc_sql("(select * from reduced where class<>'tampered')", 'reduction')} s on s.reduction=a.reduction
  join {auc_sql("(select * from reduced where class<>'synthetic')", 'reduction')} t on t.reduction=a.reduction
  join {matched_sql('reduced', 'reduction')} m on m.reduction=a.reduction""",
)
def decision_sweep(spark, sf):
    """The whole-image score, eleven reductions of a map and eighteen of its regions, ranked."""
    tiles = tiles_by_image(spark, sf)
    whole = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit("whole_image_only").alias("reduction"), (F.col("label") / 9.0).alias("score"))
    reduced = whole.unionByName(evaluation.map_reductions(tiles, ["image_id"])).unionByName(regions.region_reductions(tiles, highs=CUTS, areas=AREAS))
    kind = F.element_at(F.array(F.lit("real"), F.lit("synthetic"), F.lit("tampered")), (F.col("image_id") % 3 + 1).cast("int"))
    scored = durable(reduced.select("image_id", "reduction", F.round("score", 9).alias("score"), kind.alias("class"), (F.col("image_id") % 3 != 0).cast("int").alias("label")))
    swept = evaluation.decision_sweep(scored)
    place = F.row_number().over(Window.orderBy(F.round("auc_real_vs_ai", 9).desc(), "reduction"))  # thirty rows
    return rounded(swept.withColumn("place", place))
