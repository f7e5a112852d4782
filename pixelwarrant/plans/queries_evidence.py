"""Queries over routing, evidence scorers, fusion, verdicts, forensics and scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from pixelwarrant import fixtures as fx
from pixelwarrant.functions import scalar
from pixelwarrant.operators import dataset as ds
from pixelwarrant.operators import components, degrade, evidence, forensics, fusion, grid, routing, severities, spectral
from pixelwarrant.plans import analyze
from pixelwarrant.plans import queries_regions as qr
from pixelwarrant.plans.queries_dataset import REQUESTS, paths
from pixelwarrant.plans.queries_grid import gauss_sql, tiles_by_image
from pixelwarrant.plans.registry import cte, query
from pixelwarrant.plans.rounding import rounded
from pixelwarrant.session import durable
from pixelwarrant.sources import tables

# --- region facts: one made-up region per scored window, so that rules see every branch ---

FACTS_SQL = """select image_id, patch_no as region_id, w*31+h*17 as k, ((w%100)/1e2)*((h%100)/1e2) as area_frac, ((w*h)%900)::int as area_px, 5e-1+((w*7)%50)/1e2 as mean_score, least(1e0,6e-1+((w*7)%50)/1e2) as max_score,
  (h%30)/1e2 as heat_std, ((h*3)%100)/1e2 as support, ((w*3)%40)/1e2 as scale_disagreement, ((h*7)%100)/1e2 as fine, ((w*11)%100)/1e2 as coarse, ((w*31+h*17)%60)/1e3 as boundary_sharpness, ((h*11)%100)/1e2 as fill_ratio,
  case when (w*31+h*17)%9=0 then (w%60+40)/1e2 end as face_overlap, (w*31+h*17)%10<>0 as valid, ((w*17)%201-100)/1e2 as noise_contrast, ((h*19)%201-100)/1e2 as high_freq_contrast, ((w*23)%201-100)/1e2 as jpeg_grid_contrast,
  ((h*29)%201-100)/1e2 as ela_contrast, ((w*37)%201-100)/1e2 as channel_corr_contrast, 1e0+((h*13)%40)/1e2 as jpeg_grid_inside, 1e0+((w*19)%40)/1e2 as jpeg_grid_outside, ((h*5)%100)/1e2 as edge_straightness,
  ((w*23)%100)/1e2 as crop_score, ((image_id*37)%100)/1e2 as whole_image_score, case when (w*31+h*17)%4<>0 then ((w*29)%100)/1e2 end as eye_line_asymmetry, (w*31+h*17)%3<>0 as face_valid,
  ((h*31)%201-100)/1e2 as face_noise_contrast, ((w*41)%201-100)/1e2 as face_high_freq_contrast, ((h*43)%100)/1e2 as face_crop_score, (w%50)::int as x0, (h%50)::int as y0, (w%50+1+w%30)::int as x1, (h%50+1+h%30)::int as y1
  from patches"""
cte("facts", FACTS_SQL, ("patches",))


def region_facts(spark, sf):
    w, h, i = F.col("w"), F.col("h"), F.col("image_id")
    k = w * 31 + h * 17
    pct = lambda e, n: e % n / F.lit(100.0)
    signed = lambda e: (e % 201 - 100) / F.lit(100.0)
    p = fx.patches(spark, sf)
    return p.select(
        "image_id",
        F.col("patch_no").alias("region_id"),
        k.alias("k"),
        (pct(w, 100) * pct(h, 100)).alias("area_frac"),
        (w * h % 900).cast("int").alias("area_px"),
        (0.5 + pct(w * 7, 50)).alias("mean_score"),
        F.least(F.lit(1.0), 0.6 + pct(w * 7, 50)).alias("max_score"),
        pct(h, 30).alias("heat_std"),
        pct(h * 3, 100).alias("support"),
        pct(w * 3, 40).alias("scale_disagreement"),
        F.create_map(F.lit(64), pct(h * 7, 100), F.lit(224), pct(w * 11, 100)).alias("scale_profile"),
        (k % 60 / F.lit(1000.0)).alias("boundary_sharpness"),
        pct(h * 11, 100).alias("fill_ratio"),
        F.when(k % 9 == 0, (w % 60 + 40) / F.lit(100.0)).alias("face_overlap"),
        (k % 10 != 0).alias("valid"),
        signed(w * 17).alias("noise_contrast"),
        signed(h * 19).alias("high_freq_contrast"),
        signed(w * 23).alias("jpeg_grid_contrast"),
        signed(h * 29).alias("ela_contrast"),
        signed(w * 37).alias("channel_corr_contrast"),
        (1.0 + pct(h * 13, 40)).alias("jpeg_grid_inside"),
        (1.0 + pct(w * 19, 40)).alias("jpeg_grid_outside"),
        pct(h * 5, 100).alias("edge_straightness"),
        pct(w * 23, 100).alias("crop_score"),
        pct(i * 37, 100).alias("whole_image_score"),
        F.when(k % 4 != 0, pct(w * 29, 100)).alias("eye_line_asymmetry"),
        (k % 3 != 0).alias("face_valid"),
        signed(h * 31).alias("face_noise_contrast"),
        signed(w * 41).alias("face_high_freq_contrast"),
        pct(h * 43, 100).alias("face_crop_score"),
        F.struct(
            (w % 50).cast("int").alias("x0"),
            (h % 50).cast("int").alias("y0"),
            (w % 50 + 1 + w % 30).cast("int").alias("x1"),
            (h % 50 + 1 + h % 30).cast("int").alias("y1"),
        ).alias("bbox"),
    )


def clip_sql(e: str) -> str:
    return f"greatest(0e0,least(1e0,{e}))"


def blend_sql(*terms: tuple[str, str]) -> str:
    weights = [f"(case when ({v}) is not null and coalesce({w},0)>0 then {w} else 0 end)" for v, w in terms]
    top = "+".join(f"coalesce(({v})*{w},0)" for (v, _), w in zip(terms, weights))
    total = "+".join(weights)
    return f"(case when ({total})>0 then {clip_sql(f'({top})/({total})')} else 5e-1 end)"


def squash_sql(e: str, s: float) -> str:
    return f"(5e-1*(1+tanh(({e})/{s}::double)))"


def pct_sql(e: str) -> str:
    return f"(round(({e})*100,0)::int::varchar||'%')"


COMP = clip_sql("(greatest(jpeg_grid_inside,jpeg_grid_outside)-1)/15e-2")
EVD = {}
EVD["inpainting"] = f"""select image_id, region_id, case when valid then {blend_sql((squash_sql('-noise_contrast', 0.25), '1e0'), (squash_sql('-high_freq_contrast', 0.30), '8e-1'), (squash_sql('abs(jpeg_grid_contrast)', 0.20), '(cw*8e-1)'), (f"5e-1+5e-1*{clip_sql('boundary_sharpness/4e-2')}", '5e-1'), ('mean_score', '12e-1'), ('crop_score', '8e-1'))} else {clip_sql('mean_score')} end as probability,
 case when not valid then 15e-2 when n=0 then least(conf,3e-1) else conf end as confidence, null::varchar as kind, case when not valid or n=0 then 1 else n end::int as n_evidence from
 (select *, least(9e-1, 25e-2+35e-2*(case when abs({squash_sql('-noise_contrast', 0.25)}-5e-1)>2e-2 and abs({squash_sql('-high_freq_contrast', 0.30)}-5e-1)>2e-2 then abs(sign({squash_sql('-noise_contrast', 0.25)}-5e-1)+sign({squash_sql('-high_freq_contrast', 0.30)}-5e-1))/2 else 0 end)+2e-1*cw+2e-1*least(1,area_frac/5e-2)) as conf,
  (abs(noise_contrast)>8e-2)::int+(high_freq_contrast<-8e-2)::int+(cw>2e-1 and abs(jpeg_grid_contrast)>8e-2)::int+(boundary_sharpness>4e-2)::int as n from (select *, {COMP} as cw from facts))"""
EVD["compositing"] = f"""select image_id, region_id, case when valid then {blend_sql((squash_sql('abs(noise_contrast)', 0.25), '1e0'), (squash_sql('abs(jpeg_grid_contrast)', 0.20), '(cw*12e-1)'), (squash_sql('ela_contrast', 0.25), 'cw'), (squash_sql('abs(channel_corr_contrast)', 0.30), '6e-1'), (clip_sql('5e-1+edge_straightness*5e-1'), '8e-1'), ('mean_score', '8e-1'))} else {clip_sql('mean_score')} end as probability,
 case when not valid then 15e-2 when n=0 then least(conf,25e-2) else conf end as confidence, case when valid then case when share>65e-2 then 'generative' when share<35e-2 then 'conventional' else 'ambiguous' end end as kind, case when not valid or n=0 then 1 else n end::int as n_evidence from
 (select *, least(85e-2, 2e-1+3e-1*cw+25e-2*least(1,abs(noise_contrast)/25e-2)+15e-2*edge_straightness) as conf,
  (abs(noise_contrast)>1e-1)::int+(cw>2e-1 and abs(jpeg_grid_contrast)>8e-2)::int+(cw>2e-1 and ela_contrast>1e-1)::int+(edge_straightness>35e-2)::int+(abs(channel_corr_contrast)>15e-2)::int+(lean>15e-2 and (share<35e-2 or share>65e-2))::int as n from
  (select *, case when ai+con>1e-6 then ai/(ai+con) else 5e-1 end as share, abs(noise_contrast)+greatest(0,-high_freq_contrast)+cw*(abs(jpeg_grid_contrast)+greatest(0,ela_contrast)) as lean from
  (select *, greatest(0,-noise_contrast)+greatest(0,-high_freq_contrast) as ai, greatest(0,noise_contrast)+cw*(abs(jpeg_grid_contrast)+greatest(0,ela_contrast)) as con from (select *, {COMP} as cw from facts))))"""
EVD["synthesis"] = f"""select image_id, region_id, {blend_sql(('whole_image_score', '2e0'), ('mean_score', '1e0'), ('whole_image_score', 'cov'), ('5e-1+agr*(mean_score-5e-1)', '6e-1'))} as probability, least(95e-2, 3e-1+3e-1*cov+25e-2*agr+15e-2*uni) as confidence, null::varchar as kind,
 ((area_frac>4e-1)::int+(agr>6e-1)::int+(uni>6e-1)::int+1)::int as n_evidence from (select *, {clip_sql('area_frac/55e-2')} as cov, {clip_sql('1-scale_disagreement/15e-2')} as agr, {clip_sql('1-heat_std/2e-1')} as uni from facts)"""
EVD["face_edit"] = f"""select image_id, region_id, {blend_sql(('mean_score', '1e0'), ('face_crop_score', '12e-1'), (squash_sql('-face_noise_contrast', 0.25), '(case when face_valid then 1e0 end)'), (squash_sql('-face_high_freq_contrast', 0.30), '(case when face_valid then 8e-1 end)'), (f"case when eye_line_asymmetry is not null then {clip_sql('5e-1+eye_line_asymmetry')} end", '5e-1'))} as probability,
 least(55e-2, 2e-1+case when face_valid then 25e-2 else 0 end+15e-2*least(1,area_frac/3e-2)) as confidence, null::varchar as kind,
 (2+(face_valid and abs(face_noise_contrast)>1e-1)::int+(face_valid and face_high_freq_contrast<-1e-1)::int+(not face_valid)::int+coalesce((eye_line_asymmetry>12e-2)::int,0))::int as n_evidence from facts"""
EVD["fallback"] = f"""select image_id, region_id, {blend_sql(('mean_score', '1e0'), ('crop_score', '1e0'))} as probability, least(35e-2, 1e-1+1e-1*least(1,area_frac/5e-2)+1e-1*{clip_sql('1-scale_disagreement/2e-1')}) as confidence, null::varchar as kind,
 (2+(scale_disagreement>15e-2)::int+(support<4e-1)::int+(area_frac<1e-2)::int)::int as n_evidence from facts"""
for _name, _sql in EVD.items():
    cte(f"ev_{_name}", _sql, ("facts",))


def _scorer_query(name: str, number: int):
    @query(
        f"evd{number:02d}_{name}",
        (f"ev_{name}",),
        f"select image_id, region_id, round(probability,6) as probability, round(confidence,6) as confidence, kind, n_evidence from ev_{name}",
    )
    def build(spark, sf):
        out = evidence.prepared(region_facts(spark, sf)).withColumn("r", evidence.SCORERS[name]())
        return rounded(
            out.select("image_id", "region_id", "r.probability", "r.confidence", "r.kind", F.size("r.evidence").alias("n_evidence"))
        )

    return build


for _number, _name in ((3, "inpainting"), (4, "compositing"), (5, "synthesis"), (6, "face_edit"), (7, "fallback")):
    _scorer_query(_name, _number)


@query(
    "evd01_weighted_blend",
    ("facts",),
    f"select image_id, region_id, round({blend_sql(('mean_score', 'support'), ('crop_score', 'noise_contrast'), ('eye_line_asymmetry', '5e-1'))},9) as p from facts",
)
def weighted_blend(spark, sf):
    p = scalar.blend((F.col("mean_score"), F.col("support")), (F.col("crop_score"), F.col("noise_contrast")), (F.col("eye_line_asymmetry"), 0.5))
    return rounded(region_facts(spark, sf).select("image_id", "region_id", p.alias("p")), 9)


@query("evd02_squash", ("facts",), f"select image_id, region_id, round({squash_sql('noise_contrast', 0.25)},6) as s from facts")
def squash(spark, sf):
    return rounded(region_facts(spark, sf).select("image_id", "region_id", scalar.squash(F.col("noise_contrast"), 0.25).alias("s")))


LEAD = "fine-coarse"
cte(
    "weak",
    f"""select *, {LEAD} as lead_, list_filter([case when mean_score<6e-1 then 'mean score only '||{pct_sql('mean_score')} end, case when support<35e-2 then 'window support only '||{pct_sql('support')} end,
  case when area_frac<8e-3 then 'area only '||{pct_sql('area_frac')} end, case when scale_disagreement-greatest(0,{LEAD})>22e-2 then 'unexplained scale spread '||{pct_sql(f'scale_disagreement-greatest(0,{LEAD})')} end], lambda r: r is not null) as reasons from facts""",
    ("facts",),
)
cte(
    "routed",
    f"""select *, case when face_overlap is not null then 'face_edit' when area_frac>=55e-2 and scale_disagreement<=12e-2 then 'synthesis' when len(reasons)>0 then 'fallback' when lead_>=6e-2 and boundary_sharpness>=3e-2 then 'inpainting'
   when fill_ratio>=88e-2 or boundary_sharpness>=3e-2 then 'compositing' else 'inpainting' end as prim,
  case when face_overlap is not null then ['inpainting'] when area_frac>=55e-2 and scale_disagreement<=12e-2 then [] when len(reasons)>0 then [] when lead_>=6e-2 and boundary_sharpness>=3e-2 then ['compositing']
   when fill_ratio>=88e-2 or boundary_sharpness>=3e-2 then ['inpainting'] else ['compositing'] end as alternates,
  case when face_overlap is not null then 'face box covers '||{pct_sql('face_overlap')} when area_frac>=55e-2 and scale_disagreement<=12e-2 then 'scales agree over '||{pct_sql('area_frac')}||' of the frame' when len(reasons)>0 then array_to_string(reasons,'; ')
   when lead_>=6e-2 and boundary_sharpness>=3e-2 then 'local evidence, fine scale leads by '||{pct_sql('lead_')} when fill_ratio>=88e-2 then 'box shape, fills '||{pct_sql('fill_ratio')} when boundary_sharpness>=3e-2 then 'sharp rim without fine-scale lead' else 'no distinguishing geometry' end as reason
  from weak""",
    ("weak",),
)


def routed(spark, sf):
    return routing.with_route(region_facts(spark, sf))


@query("prj24_router", ("routed",), "select image_id, region_id, prim as primary_route, alternates, reason from routed")
def router(spark, sf):
    return routed(spark, sf).select("image_id", "region_id", F.col("route.primary").alias("primary_route"), "route.alternates", "route.reason")


@query("prj25_weak_reasons", ("weak",), "select image_id, region_id, reasons from weak where len(reasons)>0")
def weak_reasons(spark, sf):
    out = routing.with_lead(region_facts(spark, sf)).withColumn("reasons", routing.weak_reasons())
    return out.where(F.size("reasons") > 0).select("image_id", "region_id", "reasons")


cte("named", "select *, unnest(list_concat([prim], case when area_frac>=2e-2 then alternates else [] end)) as specialist from routed", ("routed",))


@query("prj26_scorers_to_run", ("named",), "select image_id, region_id, specialist from named")
def scorers_to_run(spark, sf):
    return routed(spark, sf).select("image_id", "region_id", F.explode(routing.names_to_run()).alias("specialist"))


cte("all_ev", " union all ".join(f"select *, '{n}' as specialist from ev_{n}" for n in EVD), tuple(f"ev_{n}" for n in EVD))
cte(
    "results",
    "select n.*, e.probability, e.confidence, e.kind, e.n_evidence from named n join all_ev e on e.image_id=n.image_id and e.region_id=n.region_id and e.specialist=n.specialist",
    ("named", "all_ev"),
)


def results(spark, sf):
    return evidence.run_scorers(routed(spark, sf).withColumn("scorers", routing.names_to_run()))


@query("evd08_scorer_dispatch", ("results",), "select image_id, region_id, specialist, round(probability,6) as probability, round(confidence,6) as confidence from results")
def scorer_dispatch(spark, sf):
    return rounded(results(spark, sf).select("image_id", "region_id", "specialist", "result.probability", "result.confidence"))


MAPCONF = clip_sql(f"35e-2*{clip_sql('(mean_score-75e-2)/25e-2')}+35e-2*{clip_sql('support/6e-1')}+3e-1*{clip_sql('1-scale_disagreement/25e-2')}")
cte(
    "findings",
    f"""select *, least(shrunk, 5e-1+5e-1*(35e-2+65e-2*map_conf)) as probability, {clip_sql('5e-1*map_conf+5e-1*sconf')} as confidence,
  case when prim='synthesis' then 'generated_content' when prim='face_edit' then 'face_region_edit_evidence' when kind='conventional' then 'conventional_manipulation' when prim='fallback' then 'uncharacterised_suspicion' else 'generative_edit' end as label from
  (select *, sconf*sp+(1-sconf)*mean_score as shrunk, {MAPCONF} as map_conf from
   (select image_id, region_id, prim, area_frac, mean_score, support, scale_disagreement, sum(probability*confidence)/sum(confidence) as sp, {clip_sql('max(confidence)*(1-5e-1*(max(probability)-min(probability)))')} as sconf, max(kind) filter (specialist=prim) as kind, sum(n_evidence)::int as n_evidence
    from results group by 1,2,3,4,5,6,7))""",
    ("results",),
)


def findings(spark, sf):
    return fusion.fuse_regions(results(spark, sf))


@query("agg38_map_confidence", ("facts",), f"select image_id, region_id, round({MAPCONF},9) as map_conf from facts")
def map_confidence(spark, sf):
    return rounded(region_facts(spark, sf).select("image_id", "region_id", fusion.map_confidence().alias("map_conf")), 9)


@query(
    "agg39_region_fusion",
    ("findings",),
    "select image_id, region_id, round(sp,9) as specialist_p, round(sconf,9) as specialist_conf, round(probability,9) as probability, round(confidence,9) as confidence, (n_evidence+(probability<shrunk-1e-6)::int)::int as n_evidence from findings",
)
def region_fusion(spark, sf):
    return rounded(findings(spark, sf).select("image_id", "region_id", "specialist_p", "specialist_conf", "probability", "confidence", F.size("evidence").alias("n_evidence")), 9)


@query("prj27_finding_label", ("findings",), "select image_id, region_id, label from findings")
def finding_label(spark, sf):
    return findings(spark, sf).select("image_id", "region_id", "label")


cte(
    "image_local",
    """select image_id, 5e-1+5e-1*(1-exp(sum(ln(1-least(999e-3,greatest(0,probability-5e-1)/5e-1*(4e-1+6e-1*confidence)))))) as local_score, count(*) as n_findings, count(*) filter (prim='synthesis') as n_synthesis,
  count(*) filter (label='conventional_manipulation') as n_conventional, sum(area_frac) as coverage, max(confidence) as finding_conf from findings group by image_id""",
    ("findings",),
)
cte(
    "image_view",
    "select distinct image_id, ((image_id*37)%100)/1e2 as whole_image_score, ((image_id*13)%100)/1e2 as frac_uncertain, ((image_id*29)%100)/1e2 as mean_support from patches",
    ("patches",),
)
cte(
    "verdicts",
    """select *, case when confidence<35e-2 then 'uncertain' when score<5e-1 and n_findings=0 then 'likely_authentic' when score<5e-1 then 'likely_authentic_with_open_questions' when (local_score is null or whole_image_score>=local_score) and whole_image_score>=5e-1 then 'ai_generated'
   when n_synthesis>0 and coverage>=5e-1 then 'ai_generated' when n_conventional>0 and n_conventional>=greatest(1,ceil(n_findings/2e0)) then 'manipulated_not_necessarily_ai' when n_findings>0 then 'ai_edited' else 'ai_generated' end as verdict from
  (select *, least(raw,6e-1) as confidence, raw>6e-1 as capped from (select v.*, l.local_score, coalesce(n_findings,0) as n_findings, coalesce(n_synthesis,0) as n_synthesis, coalesce(n_conventional,0) as n_conventional, coalesce(coverage,0) as coverage,
    greatest(whole_image_score, coalesce(l.local_score,0)) as score, greatest(0,least(1,35e-2*(1-frac_uncertain)+4e-1*greatest(coalesce(finding_conf,0),least(1,abs(whole_image_score-5e-1)*2))+25e-2*mean_support)) as raw from image_view v left join image_local l on l.image_id=v.image_id))""",
    ("image_view", "image_local"),
)


def image_view(spark, sf):
    i = F.col("image_id")
    pct = lambda e: e % 100 / F.lit(100.0)
    return fx.patches(spark, sf).select(i).distinct().select(
        i, pct(i * 37).alias("whole_image_score"), pct(i * 13).alias("frac_uncertain"), pct(i * 29).alias("mean_support")
    )


def verdicts(spark, sf):
    return fusion.fuse_images(image_view(spark, sf), findings(spark, sf))


@query("agg40_noisy_or", ("image_local",), "select image_id, round(local_score,10) as local_score, n_findings from image_local")
def noisy_or(spark, sf):
    return rounded(fusion.image_evidence(findings(spark, sf)).select("image_id", "local_score", "n_findings"), 10)


@query("agg41_image_confidence", ("verdicts",), "select image_id, round(raw,10) as uncapped_confidence, round(coverage,10) as coverage, round(score,10) as score from verdicts")
def image_confidence(spark, sf):
    return rounded(verdicts(spark, sf).select("image_id", "uncapped_confidence", "coverage", "score"), 10)


@query("prj28_verdict", ("verdicts",), "select image_id, verdict from verdicts")
def verdict(spark, sf):
    return verdicts(spark, sf).select("image_id", "verdict")


@query("prj35_uncalibrated_cap", ("verdicts",), "select image_id, round(confidence,9) as confidence, capped as capped_by_calibration from verdicts")
def uncalibrated_cap(spark, sf):
    return rounded(verdicts(spark, sf).select("image_id", "confidence", "capped_by_calibration"), 9)


@query(
    "prj36_notes",
    ("verdicts",),
    "select image_id, list_filter(['map is uncalibrated; confidence is capped', case when n_findings=0 then 'no region above the threshold; the score is the whole image''s' end], lambda t: t is not null) as notes from verdicts",
)
def notes(spark, sf):
    return verdicts(spark, sf).select("image_id", "notes")


@query(
    "srt05_strongest_finding",
    ("findings",),
    "select image_id, region_id, n_shown from (select *, least(3, n_evidence+(probability<shrunk-1e-6)::int)::int as n_shown, row_number() over (partition by image_id order by round(probability*confidence,12) desc, region_id) as r from findings) where r=1",
)
def strongest_finding(spark, sf):
    top = fusion.image_evidence(findings(spark, sf))
    return top.select("image_id", "strongest.region_id", F.size("strongest.evidence").alias("n_shown"))


cte(
    "strongest",
    "select * from (select *, row_number() over (partition by image_id order by round(probability*confidence,12) desc, region_id) as r from findings) where r=1",
    ("findings",),
)
HEAD_SQL = "case verdict " + " ".join(f"when '{k}' then '{v}'" for k, v in fusion.HEADLINES.items()) + " end"


@query(
    "prj29_explanation",
    ("verdicts", "strongest", "routed"),
    f"""select v.image_id, {HEAD_SQL} as headline, case when v.n_findings>0 then 'Strongest region covers '||{pct_sql('s.area_frac')}||', sent to '||s.prim||': '||q.reason||'.' else 'No region above 75%; whole-image score '||{pct_sql('v.whole_image_score')}||'.' end as main_part,
  'Score '||{pct_sql('v.score')}||', confidence '||{pct_sql('v.confidence')}||'.' as closing from verdicts v left join strongest s on s.image_id=v.image_id left join routed q on q.image_id=s.image_id and q.region_id=s.region_id""",
)
def explanation(spark, sf):
    """The fixed parts of the paragraph: headline, strongest region, closing numbers."""
    out = verdicts(spark, sf).select("image_id", "verdict", "explanation", "n_findings")
    headline = F.element_at(F.create_map(*[F.lit(t) for kv in fusion.HEADLINES.items() for t in kv]), F.col("verdict"))
    rest = F.expr("substring(explanation, length(headline) + 2)")
    return (
        out.withColumn("headline", headline)
        .withColumn("rest", rest)
        .select(
            "image_id",
            "headline",
            F.when(F.col("n_findings") > 0, F.regexp_extract("rest", r"^(Strongest .*?\.)( Found| \d+ more| \d+% of|$)", 1))
            .otherwise(F.regexp_extract("rest", r"^(No region .*?%\.)", 1))
            .alias("main_part"),
            F.regexp_extract("rest", r"(Score -?\d+%, confidence \d+%\.)$", 1).alias("closing"),
        )
    )


@query(
    "src14_region_report",
    ("verdicts", "findings"),
    """select v.image_id, v.verdict, round(v.score,10) as score, coalesce(f.n,0)::int as n_regions, coalesce(f.labels,[]) as labels from verdicts v left join
  (select image_id, count(*) as n, list(label order by region_id) as labels from findings group by image_id) f on f.image_id=v.image_id""",
)
def region_report_sink(spark, sf):
    from pixelwarrant.operators.fusion import nested_report

    found = findings(spark, sf)
    report = nested_report(fusion.fuse_images(image_view(spark, sf), found), found)
    out = tables.scratch_dir(spark, "report")
    tables.write_json(report, out)
    report = spark.read.schema(report.schema).json(out)
    return rounded(report.select("image_id", "verdict", "score", F.size("regions").alias("n_regions"), F.col("regions.label").alias("labels")), 10)


@query(
    "prj10_score_provenance",
    ("arms",),
    "select 'arms' as scorer, 'jvm' as device, map([0,1],['real','fake']) as id2label, [1] as positive_indices, 'explicit index' as resolved_by, count(*) as n from arms",
)
def score_provenance(spark, sf):
    described = fx.arms(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    return described.select(
        F.lit("arms").alias("scorer"),
        F.lit("jvm").alias("device"),
        F.create_map(F.lit(0), F.lit("real"), F.lit(1), F.lit("fake")).alias("id2label"),
        F.array(F.lit(1)).alias("positive_indices"),
        F.lit("explicit index").alias("resolved_by"),
        "n",
    )


# --- crops and boxes ----------------------------------------------------------------------


@query(
    "sca12_padded_and_scaled_boxes",
    ("facts",),
    """select image_id, region_id, greatest(0,x0-8) as px0, greatest(0,y0-8) as py0, least(100,x1+8) as px1, least(100,y1+8) as py1,
  [round_even(x0*15e-1,0)::int,round_even(y0*15e-1,0)::int,round_even(x1*15e-1,0)::int,round_even(y1*15e-1,0)::int] as original from facts""",
)
def boxes(spark, sf):
    b = scalar.padded_box(F.col("bbox"), 8, F.lit(100), F.lit(100))
    return region_facts(spark, sf).select(
        "image_id", "region_id", b["x0"].alias("px0"), b["y0"].alias("py0"), b["x1"].alias("px1"), b["y1"].alias("py1"),
        scalar.scaled_box(F.col("bbox"), F.lit(1.5)).alias("original"),
    )


CROP_SQL = """select k.image_id, k.region_id, round(case when least(least(8,k.x1+1)-greatest(0,k.x0-1), least(8,k.y1+1)-greatest(0,k.y0-1))>=4 then
  (select avg(t.heat) from tiles t where t.image_id=k.image_id and t.x>=k.x0-1 and t.x<k.x1+1 and t.y>=k.y0-1 and t.y<k.y1+1) else k.mean_score end,6) as crop_score from region_kept k"""


def mean_scorer(cells):
    from pixelwarrant.operators import windows

    return lambda boxes: windows.window_means(boxes, cells, {"score": F.col("heat")})


@query("evd09_crop_rescore", ("region_kept", "tiles"), CROP_SQL)
def crop_rescore(spark, sf):
    found, *_ = qr.tile_regions(spark, sf)
    return rounded(analyze._crop_scores(found, mean_scorer(fx.tiles(spark, sf)), 1, "crop_score", min_side=4))


# --- forensics on tiles -------------------------------------------------------------------

cte("dct_basis", "select u, x, 5e-1*cos((2*x+1)*u*pi()/16)*case when u=0 then 1/sqrt(2e0) else 1 end as b from (select unnest(range(0,8)) as u), (select unnest(range(0,8)) as x)")
cte("tile_coef", "select t.image_id, p.u, q.u as v, sum(t.v*p.b*q.b) as c from tiles t join dct_basis p on p.x=t.y join dct_basis q on q.x=t.x group by 1,2,3", ("tiles", "dct_basis"))
cte(
    "tile_ela",
    "select t.image_id, t.y, t.x, abs(t.v-sum(round_even(c.c/2e-2,0)*2e-2*p.b*q.b)) as ela from tiles t join tile_coef c on c.image_id=t.image_id join dct_basis p on p.u=c.u and p.x=t.y join dct_basis q on q.u=c.v and q.x=t.x group by t.image_id, t.y, t.x, t.v",
    ("tiles", "tile_coef", "dct_basis"),
)
cte("tile_rgb", "select image_id, y, x, v as r, heat as g, v*v as b from tiles", ("tiles",))
cte(
    "tile_measured",
    f"""select t.image_id, t.y, t.x, t.v, t.v-a.g as res, (t.v-f.g)*(t.v-f.g) as fine_sq, (t.v-c.g)*(t.v-c.g) as coarse_sq, q.r-cr.g as res_r, q.g-cg.g as res_g, q.b-cb.g as res_b, e.ela from tiles t
  join {gauss_sql('tiles', 'v', 1.0)} a on a.image_id=t.image_id and a.y=t.y and a.x=t.x join {gauss_sql('tiles', 'v', 0.8)} f on f.image_id=t.image_id and f.y=t.y and f.x=t.x
  join {gauss_sql('tiles', 'v', 3.0)} c on c.image_id=t.image_id and c.y=t.y and c.x=t.x join tile_rgb q on q.image_id=t.image_id and q.y=t.y and q.x=t.x
  join {gauss_sql('tile_rgb', 'r', 1.0)} cr on cr.image_id=t.image_id and cr.y=t.y and cr.x=t.x join {gauss_sql('tile_rgb', 'g', 1.0)} cg on cg.image_id=t.image_id and cg.y=t.y and cg.x=t.x
  join {gauss_sql('tile_rgb', 'b', 1.0)} cb on cb.image_id=t.image_id and cb.y=t.y and cb.x=t.x join tile_ela e on e.image_id=t.image_id and e.y=t.y and e.x=t.x""",
    ("tiles", "tile_rgb", "tile_ela"),
)


def rgb(cells):
    return cells.withColumns({"luma": F.col("v"), "r": F.col("v"), "g": F.col("heat"), "b": F.col("v") * F.col("v")})


def measured_tiles(spark, sf):
    return forensics.measured_cells(rgb(tiles_by_image(spark, sf)))


@query("grid12_noise_level", ("tile_measured",), "select image_id, round(14826e-4*quantile_cont(abs(res-m),5e-1),6) as noise from (select *, quantile_cont(res,5e-1) over (partition by image_id) as m from tile_measured) group by image_id")
def noise_level(spark, sf):
    res = grid.residual(tiles_by_image(spark, sf), "v", "res", 1.0)
    return rounded(forensics.noise_level(res, ["image_id"]))


@query("grid14_high_frequency_ratio", ("tile_measured",), "select image_id, round(avg(fine_sq)/(avg(coarse_sq)+1e-8),6) as ratio from tile_measured group by image_id")
def high_frequency_ratio(spark, sf):
    cells = grid.residual(tiles_by_image(spark, sf), "v", "f", 0.8)
    cells = grid.residual(cells, "v", "c", 3.0)
    squared = cells.withColumns({"fine_sq": F.col("f") * F.col("f"), "coarse_sq": F.col("c") * F.col("c")})
    return rounded(squared.groupBy("image_id").agg(forensics.high_freq_ratio().alias("ratio")))


STEPS = """(select image_id, y, x, abs(lead(v) over (partition by image_id,y order by x)-v) as sx, abs(lead(v) over (partition by image_id,x order by y)-v) as sy from tiles)"""


@query(
    "grid15_blockiness",
    ("tiles",),
    f"""select image_id, round((sum(s) filter (o)/count(s) filter (o)+1e-8)/(sum(s) filter (not o)/count(s) filter (not o)+1e-8),6) as jpeg_grid from
  (select image_id, sx as s, (x+1)%4=0 as o from {STEPS} where sx is not null union all select image_id, sy, (y+1)%4=0 from {STEPS} where sy is not null) group by image_id""",
)
def blockiness(spark, sf):
    return rounded(forensics.blockiness(tiles_by_image(spark, sf), luma="v", lattice=4))


CORR = "case when stddev_pop({a})*stddev_pop({b})>1e-8 then covar_pop({a},{b})/(stddev_pop({a})*stddev_pop({b})+1e-8) else 0 end"
CORR3 = "(" + "+".join(CORR.format(a=f"res_{a}", b=f"res_{b}") for a, b in (("r", "g"), ("r", "b"), ("g", "b"))) + ")/3"


@query("grid16_channel_correlation", ("tile_measured",), f"select image_id, round({CORR3},6) as correlation from tile_measured group by image_id")
def channel_correlation(spark, sf):
    cells = spectral.channel_residuals(rgb(tiles_by_image(spark, sf)))
    return rounded(cells.groupBy("image_id").agg(spectral.channel_correlation().alias("correlation")))


@query(
    "grid17_contrast",
    ("facts",),
    "select image_id, region_id, round(case when abs(noise_contrast)+abs(ela_contrast)<1e-8 then 0 else greatest(-1,least(1,(noise_contrast-ela_contrast)/(abs(noise_contrast)+abs(ela_contrast)))) end,6) as c from facts",
)
def contrast(spark, sf):
    return rounded(region_facts(spark, sf).select("image_id", "region_id", scalar.contrast(F.col("noise_contrast"), F.col("ela_contrast")).alias("c")))


cte(
    "region_sides",
    """select *, case when lead(side) over (partition by image_id,region_id,y order by x)=side and lead(x) over (partition by image_id,region_id,y order by x)=x+1 then abs(lead(v) over (partition by image_id,region_id,y order by x)-v) end as sx,
   case when lead(side) over (partition by image_id,region_id,x order by y)=side and lead(y) over (partition by image_id,region_id,x order by y)=y+1 then abs(lead(v) over (partition by image_id,region_id,x order by y)-v) end as sy,
   quantile_cont(res,5e-1) over (partition by image_id,region_id,side) as mid from
   (select m.*, l.region_id, case when l.inside then 'in' else 'out' end as side from region_local l join tile_measured m on m.image_id=l.image_id and m.y=l.y and m.x=l.x where l.inside or l.halo)""",
    ("region_local", "tile_measured"),
)
cte(
    "region_sided",
    f"""select image_id, region_id, side, count(*) as n, case when count(*)<4 then 0 else 14826e-4*quantile_cont(abs(res-mid),5e-1) end as noise, avg(fine_sq)/(avg(coarse_sq)+1e-8) as high_freq, avg(ela) as ela, case when count(*)<4 then 0 else {CORR3} end as channel_corr,
  case when count(*)>=4 and (count(sx) filter ((x+1)%4=0)+count(sy) filter ((y+1)%4=0))>=2 and (count(sx) filter ((x+1)%4<>0)+count(sy) filter ((y+1)%4<>0))>=2 then
   ((coalesce(sum(sx) filter ((x+1)%4=0),0)+coalesce(sum(sy) filter ((y+1)%4=0),0))/(count(sx) filter ((x+1)%4=0)+count(sy) filter ((y+1)%4=0))+1e-8)/((coalesce(sum(sx) filter ((x+1)%4<>0),0)+coalesce(sum(sy) filter ((y+1)%4<>0),0))/(count(sx) filter ((x+1)%4<>0)+count(sy) filter ((y+1)%4<>0))+1e-8) else 1 end as jpeg_grid
  from region_sides group by 1,2,3""",
    ("region_sides",),
)
_SIDE_COLS = ", ".join(f"round(case when ok then i.{m} end,6) as {m}_inside, round(case when ok then o.{m} end,6) as {m}_outside" for m in forensics.MEASURES)
SMALL_REPORT = dict(floor=4, lattice=4, min_cells=4, min_steps=2, min_noise=4, min_corr=4)


@query(
    "grid18_region_report",
    ("region_sided",),
    f"""select i.image_id, i.region_id, ok as valid, {_SIDE_COLS}, round(case when ok then case when abs(i.noise)+abs(o.noise)<1e-8 then 0 else (i.noise-o.noise)/(abs(i.noise)+abs(o.noise)) end end,6) as noise_contrast
  from (select * from region_sided where side='in') i left join (select * from region_sided where side='out') o on o.image_id=i.image_id and o.region_id=i.region_id, lateral (select i.n>=4 and coalesce(o.n,0)>=4 as ok)""",
)
def region_report(spark, sf):
    cells = qr.tile_cells(spark, sf, measured_tiles(spark, sf))
    _, _, local, _ = qr.regions.extract_regions(cells, qr.SCALES, **qr.SETTINGS)
    report = forensics.region_report(local, **SMALL_REPORT)
    keep = ["image_id", "region_id", "valid"] + [f"{m}_{s}" for m in forensics.MEASURES for s in ("inside", "outside")]
    return rounded(report.select(*keep, "noise_contrast"))


cte(
    "mask_halves",
    "select *, case when x<mid then 'l' else 'r' end as half from (select m.image_id, m.x, m.res, floor(avg(m.x) over (partition by m.image_id)) as mid from tile_measured m join tiles t on t.image_id=m.image_id and t.y=m.y and t.x=m.x where t.heat>=5e-1)",
    ("tile_measured", "tiles"),
)


@query(
    "grid19_left_right_asymmetry",
    ("mask_halves",),
    """select image_id, 1 as region_id, round(case when cl>=4 and cr>=4 and nl+nr>=1e-6 then abs(nl-nr)/(nl+nr) end,6) as eye_line_asymmetry from
  (select image_id, max(noise) filter (half='l') as nl, max(noise) filter (half='r') as nr, max(n) filter (half='l') as cl, max(n) filter (half='r') as cr from
   (select image_id, half, count(*) as n, case when count(*)<8 then 0 else 14826e-4*quantile_cont(abs(res-m),5e-1) end as noise from (select *, quantile_cont(res,5e-1) over (partition by image_id, half) as m from mask_halves) group by 1,2) group by 1)""",
)
def left_right_asymmetry(spark, sf):
    cells = grid.residual(tiles_by_image(spark, sf), "v", "res", 1.0)
    local = cells.withColumns({"inside": F.col("heat") >= 0.5, "region_id": F.lit(1)})
    return rounded(forensics.halves_asymmetry(local, 8, 4))


@query("grid20_error_level", ("tile_ela",), "select image_id, y, x, round(ela,6) as ela from tile_ela")
def error_level(spark, sf):
    return rounded(spectral.error_level(fx.tiles(spark, sf), "v", 0.02).select("image_id", "y", "x", "ela"))


cte(
    "frames",
    "select image_id//3 as image_id, y, x, v from (select image_id, y, (image_id%3*8+x)::int as x, v from tiles) where x<21 and y<7",
    ("tiles",),
)
cte(
    "frame_blocks",
    """select f.image_id, f.by, f.bx, f.i, f.j, t.v from (select s.image_id, unnest(range(0,(h+7)//8)) as by, bx, i, j, w, h from (select image_id, w, h, unnest(range(0,(w+7)//8)) as bx from (select image_id, max(x)+1 as w, max(y)+1 as h from frames group by 1)) s,
   (select unnest(range(0,8)) as i), (select unnest(range(0,8)) as j)) f join frames t on t.image_id=f.image_id and t.y=least(f.by*8+f.i, f.h-1) and t.x=least(f.bx*8+f.j, f.w-1)""",
    ("frames",),
)
cte("frame_coef", "select t.image_id, t.by, t.bx, p.u, q.u as v, sum(t.v*p.b*q.b) as c from frame_blocks t join dct_basis p on p.x=t.i join dct_basis q on q.x=t.j group by all", ("frame_blocks", "dct_basis"))


def frames(spark, sf):
    """Strips of three tiles, 21 cells wide and 7 high: the blocks at two of their edges are cut off."""
    cells = fx.tiles(spark, sf).select(F.expr("image_id div 3").alias("image_id"), "y", (F.col("image_id") % 3 * 8 + F.col("x")).cast("int").alias("x"), "v")
    return cells.where("x < 21 and y < 7")


@query(
    "grid20_error_level_frames",
    ("frames", "frame_coef", "dct_basis"),
    """select t.image_id, t.y, t.x, round(abs(t.v-sum(round_even(c.c/2e-2,0)*2e-2*p.b*q.b)),6) as ela from frames t join frame_coef c on c.image_id=t.image_id and c.by=t.y//8 and c.bx=t.x//8
  join dct_basis p on p.u=c.u and p.x=t.y%8 join dct_basis q on q.u=c.v and q.x=t.x%8 group by t.image_id, t.y, t.x, t.v""",
)
def error_level_frames(spark, sf):
    return rounded(spectral.error_level(frames(spark, sf), "v", 0.02).select("image_id", "y", "x", "ela"))


cte(
    "components_frames",
    """select image_id, y, x, y*64+x as root from frames where v>=2e-2 union
  select m.image_id, m.y, m.x, r.root from components_frames r join (select * from frames where v>=2e-2) m on m.image_id=r.image_id and abs(m.y-r.y)<=1 and abs(m.x-r.x)<=1""",
    ("frames",),
)


@query(
    "grid09_components_over_tiles",
    ("components_frames",),
    "select image_id, y, x, dense_rank() over (partition by image_id order by root)::int as component from (select image_id, y, x, min(root) as root from components_frames group by 1,2,3)",
)
def components_over_tiles(spark, sf):
    """Components that cross the seams of tiles of five cells, on frames of 21 by 7."""
    return components.label_tiled(frames(spark, sf).withColumn("on", F.col("v") >= 0.02), "on", 5)


@query(
    "grid21_block_dct_profile",
    ("tile_coef",),
    "select image_id, (u*8+v)::int as coef, round(case when u*8+v=0 then m else m-dc end,6) as value from (select *, max(case when u*8+v=0 then m end) over (partition by image_id) as dc from (select image_id, u, v, avg(ln(1+abs(c))) as m from tile_coef group by 1,2,3))",
)
def block_dct_profile(spark, sf):
    return rounded(spectral.dct_profile(fx.tiles(spark, sf), "v"))


RES4 = gauss_sql("tiles", "v", 1.0, repeat_edge=True, truncate=4.0, half_up=True)
cte("tile_res", f"select t.image_id, t.y, t.x, t.v-g.g as res from tiles t join {RES4} g on g.image_id=t.image_id and g.y=t.y and g.x=t.x", ("tiles",))


def spectral_residual(spark, sf):
    return grid.residual(tiles_by_image(spark, sf), "v", "res", 1.0, truncate=4.0, half_up=True, repeat_edge=True)


@query(
    "grid22_residual_shape",
    ("tile_res",),
    """select image_id, round(sqrt(m2),6) as res_std, round(m3/pow(m2,15e-1),6) as res_skew, round(m4/(m2*m2)-3,6) as res_kurtosis from
  (select image_id, avg(pow(res-m,2)) as m2, avg(pow(res-m,3)) as m3, avg(pow(res-m,4)) as m4 from (select *, avg(res) over (partition by image_id) as m from tile_res) group by image_id)""",
)
def residual_shape(spark, sf):
    return rounded(spectral.residual_shape(spectral_residual(spark, sf)))


@query(
    "grid23_residual_autocorrelation",
    ("tile_res",),
    """select image_id, round(avg(res*x1)/(var_pop(res)+1e-8),6) as autocorr_dx1, round(avg(res*y1)/(var_pop(res)+1e-8),6) as autocorr_dy1, round(avg(res*x2)/(var_pop(res)+1e-8),6) as autocorr_dx2, round(avg(res*y2)/(var_pop(res)+1e-8),6) as autocorr_dy2 from
  (select *, lead(res,1) over (partition by image_id,y order by x) as x1, lead(res,2) over (partition by image_id,y order by x) as x2, lead(res,1) over (partition by image_id,x order by y) as y1, lead(res,2) over (partition by image_id,x order by y) as y2 from tile_res) group by image_id""",
)
def residual_autocorrelation(spark, sf):
    return rounded(spectral.residual_autocorrelation(spectral_residual(spark, sf)))


cte(
    "tile_spectrum",
    """select image_id, ky, kx, ln(re*re+im*im+1e-8) as log_power, sqrt(ky*ky+kx*kx) as r, ((atan2(ky,kx)+2*pi())%pi()) as a from (select t.image_id, case when p<4 then p else p-8 end/8e0 as ky, case when q<4 then q else q-8 end/8e0 as kx,
   sum(t.g*cos(2*pi()*(p*t.y+q*t.x)/8)) as re, sum(-t.g*sin(2*pi()*(p*t.y+q*t.x)/8)) as im from
   (select image_id, y, x, (v-avg(v) over (partition by image_id))*(5e-1-5e-1*cos(2*pi()*y/7))*(5e-1-5e-1*cos(2*pi()*x/7)) as g from tiles) t, (select unnest(range(0,8)) as p), (select unnest(range(0,8)) as q) group by 1,2,3)""",
    ("tiles",),
)


@query("grid24_log_power_spectrum", ("tile_spectrum",), "select image_id, ky, kx, round(log_power,5) as log_power from tile_spectrum where r<=5e-1 and (ky<>0 or kx<>0)")
def log_power_spectrum(spark, sf):
    out = spectral.log_power_spectrum(fx.tiles(spark, sf), "v")
    inner = F.sqrt(F.col("ky") * F.col("ky") + F.col("kx") * F.col("kx")) <= 0.5
    return rounded(out.where(inner & ((F.col("ky") != 0) | (F.col("kx") != 0))), 5)


cte(
    "tile_bins",
    """select image_id, profile, bin, coalesce(v, al) as value from (select i.image_id, g.profile, g.bin, b.v, sum(coalesce(b.s,0)) over (partition by i.image_id, g.profile)/sum(coalesce(b.n,0)) over (partition by i.image_id, g.profile) as al from (select distinct image_id from tile_spectrum) i,
   (select 'radial' as profile, unnest(range(0,6)) as bin union all select 'angular', unnest(range(0,4))) g left join
   (select image_id, profile, bin, avg(log_power) as v, sum(log_power) as s, count(*) as n from (select image_id, log_power, 'radial' as profile, least(5,floor(round(r/5e-1*6,9)))::int as bin from tile_spectrum where r<=5e-1 union all select image_id, log_power, 'angular', least(3,floor(round(a/pi()*4,9)))::int from tile_spectrum where r>=15e-2 and r<=5e-1) group by 1,2,3) b
   on b.image_id=i.image_id and b.profile=g.profile and b.bin=g.bin)""",
    ("tile_spectrum",),
)


def tile_spectrum(spark, sf):
    return spectral.log_power_spectrum(fx.tiles(spark, sf), "v")


@query("grid24_spectral_bins", ("tile_bins",), "select image_id, profile, bin::int as bin, round(value,5) as value from tile_bins where not (profile='radial' and bin=0)")
def spectral_bins(spark, sf):
    bins = spectral.spectral_bins(tile_spectrum(spark, sf), 6, 4)
    return rounded(bins.where(~((F.col("profile") == "radial") & (F.col("bin") == 0))), 5)


@query(
    "grid24_power_law_fit",
    ("tile_bins",),
    """select image_id, round(avg(v),4) as radial_mean, round(regr_slope(v,u),4) as slope, round(regr_intercept(v,u),4) as intercept from (select image_id, value as v, ln((bin+5e-1)/6*5e-1) as u from tile_bins where profile='radial') group by image_id""",
)
def power_law_fit(spark, sf):
    fit = spectral.power_law(spectral.spectral_bins(tile_spectrum(spark, sf), 6, 4), 6)
    return rounded(fit.select("image_id", "radial_mean", "slope", "intercept"), 4)


@query(
    "grid24_spectral_peaks",
    ("tile_spectrum",),
    """select image_id, round(coalesce(avg(log_power) filter (q>=24e-2 and q<26e-2),max(m))-5e-1*(coalesce(avg(log_power) filter (q>=2e-1 and q<24e-2),max(m))+coalesce(avg(log_power) filter (q>=26e-2 and q<3e-1),max(m))),4) as peak_half,
  round(coalesce(avg(log_power) filter (q>=35e-2 and q<5e-1),max(m))-coalesce(avg(log_power) filter (q>=5e-2 and q<15e-2),max(m)),4) as hf_ratio from (select *, round(r,12) as q, avg(log_power) filter (r<=5e-1) over (partition by image_id) as m from tile_spectrum) group by image_id""",
)
def spectral_peaks(spark, sf):
    return rounded(spectral.spectral_peaks(tile_spectrum(spark, sf)).select("image_id", "peak_half", "hf_ratio"), 4)


# --- degradations: the same steps in SQL, on long rows (image_id, c, y, x, v, w, h) --------------

_MIX = "((image_id*7919+y*104729+x*1299709+({salt})*15485863)%1000003+5e-1)/1000003"
_MIX_IMAGE = "((image_id*7919+({salt})*15485863)%1000003+5e-1)/1000003"
_CLIP = "greatest(0e0,least(1e0,{v}))"
_GREY = "(case c when 0 then 299e-3 when 1 then 587e-3 else 114e-3 end)"


def _noise_sql(src: str, p: float) -> str:
    normal = f"sqrt(-2*ln({_MIX.format(salt='2*c')}))*cos(2*pi()*{_MIX.format(salt='2*c+1')})"
    return f"(select * replace ({_CLIP.format(v=f'v+{p!r}::double*{normal}')} as v) from {src})"


def _jitter_sql(src: str, p: float) -> str:
    factor = lambda salt: f"(1+(2*{_MIX_IMAGE.format(salt=salt)}-1)*{p!r}::double)"
    lit = f"(select * replace ({_CLIP.format(v=f'v*{factor(0)}')} as v) from {src})"
    mean = f"(sum({_GREY}*v) over (partition by image_id)/(w*h))"
    return f"(select * replace ({_CLIP.format(v=f'{mean}+(v-{mean})*{factor(1)}')} as v) from {lit})"


def _saturate_sql(src: str, p: float) -> str:
    grey = f"(sum({_GREY}*v) over (partition by image_id,y,x))"
    return f"(select * replace ({_CLIP.format(v=f'{grey}+(v-{grey})*{p!r}::double')} as v) from {src})"


def _blur_sql(src: str, p: float) -> str:
    taps = ",".join(f"({k},{w!r}::double)" for k, w in grid.gaussian_taps(p))
    for at, n in (("x", "w"), ("y", "h")):
        turn = f"greatest(1,2*(t.{n}-1))"
        place = f"(((t.{at}+k.k)%{turn}+{turn})%{turn})"
        other = "y" if at == "x" else "x"
        src = f"""(select t.image_id, t.c, t.y, t.x, sum(k.wt*s.v) as v, t.w, t.h from {src} t, (values {taps}) k(k,wt), {src} s where s.image_id=t.image_id and s.c=t.c and s.{other}=t.{other}
          and s.{at}=least({place}, {turn}-{place}) group by all)"""
    return src


def _jpeg_sql(src: str, p: float) -> str:
    step = f"{max(0.004 * (100.0 - p) / 10.0, 1e-4)!r}::double"
    spots = f"""(select image_id, c, w, h, bx, unnest(range(0,(h+7)//8)) as by from (select image_id, c, w, h, unnest(range(0,(w+7)//8)) as bx from (select distinct image_id, c, w, h from {src})))"""
    blocks = f"""(select f.image_id, f.c, f.w, f.h, f.by, f.bx, i.i, j.i as j, t.v from {spots} f, (select unnest(range(0,8)) as i) i, (select unnest(range(0,8)) as i) j, {src} t
      where t.image_id=f.image_id and t.c=f.c and t.y=least(f.by*8+i.i,f.h-1) and t.x=least(f.bx*8+j.i,f.w-1))"""
    coef = f"(select t.image_id, t.c, t.w, t.h, t.by, t.bx, p.u, q.u as q, sum(t.v*p.b*q.b) as k from {blocks} t join dct_basis p on p.x=t.i join dct_basis q on q.x=t.j group by all)"
    back = f"select k.image_id, k.c, k.by*8+p.x as y, k.bx*8+q.x as x, {_CLIP.format(v=f'sum(round_even(k.k/{step},0)*{step}*p.b*q.b)')} as v, k.w, k.h from {coef} k join dct_basis p on p.u=k.u join dct_basis q on q.u=k.q group by all"
    return f"(select * from ({back}) where y<h and x<w)"


def _scaled_sql(src: str, axis: str, size: str, to: str) -> str:
    """Bilinear along one axis, from the side `size` to the side that the expression `to` gives."""
    other = "y" if axis == "x" else "x"
    step = f"({size}/({to})::double)"
    spread = f"greatest({step},1e0)"
    centre = f"((o.i+5e-1)*{step})"
    weight = f"greatest(0e0,1-abs((s.{axis}+5e-1-{centre})/{spread}))"
    keep = f"s.{axis}>=greatest(0,floor({centre}-{spread}+5e-1)) and s.{axis}<least({size},floor({centre}+{spread}+5e-1))"
    return f"""(select image_id, c, {other}, i as {axis}, sum(wt*v)/sum(wt) as v, w, h, ow, oh from (select s.image_id, s.c, s.{other}, o.i, s.v, {weight} as wt, s.w, s.h, s.ow, s.oh from {src} s,
      (select distinct image_id as oid, unnest(range(0,({to})::int)) as i from {src}) o where o.oid=s.image_id and {keep}) group by image_id, c, {other}, i, w, h, ow, oh)"""


def _resized_sql(src: str, to_w: str, to_h: str) -> str:
    rows = _scaled_sql(_scaled_sql(src, "x", "w", to_w), "y", "h", to_h)
    return f"(select image_id, c, y, x, v, ({to_w})::int as w, ({to_h})::int as h, ow, oh from {rows})"


def _resize_sql(src: str, p: float) -> str:
    start = f"(select *, w as ow, h as oh from {src})"
    small = _resized_sql(start, f"greatest(1,floor(ow*{p!r}::double))", f"greatest(1,floor(oh*{p!r}::double))")
    return f"(select image_id, c, y, x, v, w, h from {_resized_sql(small, 'ow', 'oh')})"


def _center_crop_sql(src: str, p: float) -> str:
    length = lambda n: f"floor({n}*{p!r}::double)::int"
    start = lambda n: f"floor(({n}-{length(n)})/2e0)::int"
    cut = f"""(select image_id, c, y-{start('h')} as y, x-{start('w')} as x, v, {length('w')} as w, {length('h')} as h, w as ow, h as oh from {src}
      where x>={start('w')} and x<{start('w')}+{length('w')} and y>={start('h')} and y<{start('h')}+{length('h')})"""
    return f"(select image_id, c, y, x, v, w, h from {_resized_sql(cut, 'ow', 'oh')})"


def _crop_sql(src: str, p: float) -> str:
    margin = lambda n: f"floor({n}*(1e0-{p!r}::double)/2)::int"
    return f"""(select image_id, c, y-{margin('h')} as y, x-{margin('w')} as x, v, w-2*{margin('w')} as w, h-2*{margin('h')} as h from {src}
      where x>={margin('w')} and x<w-{margin('w')} and y>={margin('h')} and y<h-{margin('h')})"""


STEP_SQL = {
    "noise": _noise_sql, "color_jitter": _jitter_sql, "saturate": _saturate_sql, "blur": _blur_sql, "jpeg": _jpeg_sql,
    "resize": _resize_sql, "downscale": _resize_sql, "center_crop": _center_crop_sql, "crop": _crop_sql,
}
cte("colour_frames", "select image_id, y, x, greatest(0e0,least(1e0,5e-1+v)) as r, greatest(0e0,least(1e0,5e-1+2*v*v)) as g, greatest(0e0,least(1e0,7e-1-v)) as b from frames", ("frames",))
cte(
    "long_frames",
    """select image_id, c, y, x, case c when 0 then r when 1 then g else b end as v, (max(x) over (partition by image_id)+1)::int as w, (max(y) over (partition by image_id)+1)::int as h
  from colour_frames, (select unnest(range(0,3)) as c)""",
    ("colour_frames",),
)


def degraded_sql(levels: dict) -> str:
    parts = []
    for name, steps in levels.items():
        src = "long_frames"
        for op, p in steps:
            src = STEP_SQL[op](src, float(p))
        parts.append(f"select '{name}' as severity, image_id, c, y, x, v from {src}")
    return " union all ".join(parts)


cte("degraded_copies", degraded_sql(severities.SEVERITIES), ("long_frames", "dct_basis"))
cte("degraded_conditions", degraded_sql(severities.CONDITIONS), ("long_frames", "dct_basis"))


def change_sql(table: str) -> str:
    per = lambda c, n: f"round(avg(d.v) filter (d.c={c}),6) as mean_{n}, round(avg((d.v-o.v)*(d.v-o.v)) filter (d.c={c}),6) as mse_{n}"
    return f"""select severity, count(*) filter (d.c=0) as n, {per(0, 'r')}, {per(1, 'g')}, {per(2, 'b')}
  from {table} d join long_frames o on o.image_id=d.image_id and o.c=d.c and o.y=d.y and o.x=d.x group by 1"""


def colour_frames(spark, sf):
    v = F.col("v")
    return frames(spark, sf).select("image_id", "y", "x", scalar.clip(0.5 + v).alias("r"), scalar.clip(0.5 + 2 * v * v).alias("g"), scalar.clip(0.7 - v).alias("b"))


def _draws():
    mixed = lambda salt, at: (F.pmod(F.col("image_id") * 7919 + at + F.lit(salt * 15485863), F.lit(1000003)) + 0.5) / 1000003.0
    return degrade.Draws(lambda salt: mixed(salt, F.col("y") * 104729 + F.col("x") * 1299709), lambda salt: mixed(salt, F.lit(0)))


def _change(spark, sf, levels):
    cells = colour_frames(spark, sf)
    changed = degrade.degrade(cells, ("r", "g", "b"), levels, _draws())
    joined = changed.join(cells.withColumnsRenamed({c: f"old_{c}" for c in "rgb"}), ["image_id", "y", "x"])
    per = [e for c in "rgb" for e in (F.avg(c).alias(f"mean_{c}"), F.avg((F.col(c) - F.col(f"old_{c}")) ** 2).alias(f"mse_{c}"))]
    return rounded(joined.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), *per))


@query("grid26_degraded_tiles", ("degraded_copies", "long_frames"), change_sql("degraded_copies"))
def degraded_tiles(spark, sf):
    """Mean and squared change of each channel under every severity, on frames with cut-off blocks."""
    return _change(spark, sf, severities.SEVERITIES)


@query("grid26_degraded_conditions", ("degraded_conditions", "long_frames"), change_sql("degraded_conditions"))
def degraded_conditions(spark, sf):
    """The same for the conditions that an analysed image is put under; crops are compared where the smaller frame lies."""
    return _change(spark, sf, severities.CONDITIONS)


# --- scalar functions ---------------------------------------------------------------------


@query(
    "sca01_normalised_labels",
    (),
    "select event_type||' #'||(event_id%7) as raw, regexp_replace(lower(event_type||' #'||(event_id%7)),'[^a-z0-9]','','g') as token, count(*) as n from events group by 1,2",
)
def normalised_labels(spark, sf):
    raw = F.concat(F.col("event_type"), F.lit(" #"), (F.col("event_id") % 7).cast("string"))
    rows = fx.table(spark, sf, "events").select(raw.alias("raw"))
    return rows.groupBy("raw", scalar.normalise_label(F.col("raw")).alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query("sca02_traceable_names", (), "select doc_id, source||'_'||lang||'_'||printf('%06d',doc_id) as stem from documents")
def traceable_names(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "source", "lang")
    return docs.select("doc_id", ds.traceable_stem(F.concat(F.lit("hub/"), "source"), F.col("lang"), F.col("doc_id")).alias("stem"))


@query(
    "sca03_severity_names",
    ("requests",),
    "select severity, regexp_extract(severity,'^([a-z_]+?)_?[sq]?[0-9]',1) as op, try_cast(regexp_extract(severity,'([0-9]+[.]?[0-9]*)',1) as double) as param, count(*) as n from requests group by 1,2,3",
)
def severity_names(spark, sf):
    names = F.array(*[F.lit(n) for n in REQUESTS])
    rows = fx.patches(spark, sf).select(
        F.element_at(names, ((F.col("image_id") + F.col("patch_no")) % 6 + 1).cast("int")).alias("severity")
    )
    counted = rows.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("severity", severities.parse_severity(F.col("severity")).alias("p"), "n").select("severity", "p.op", "p.param", "n")


@query(
    "sca04_path_parts",
    ("paths",),
    "select path, regexp_replace(split_part(path,'/',5),'[.][^.]*$','') as stem, lower(regexp_extract(split_part(path,'/',5),'([.][^.]*)$',1)) as suffix, split_part(path,'/',4) as parent from paths",
)
def path_parts(spark, sf):
    p = F.col("path")
    return paths(spark, sf).select("path", scalar.stem(p).alias("stem"), scalar.suffix(p).alias("suffix"), scalar.parent(p).alias("parent"))


@query(
    "sca05_logit_sigmoid",
    ("patches",),
    "select image_id, patch_no, round(ln(p/(1-p)),6) as z, round(1/(1+exp(-greatest(-60,least(60,2*ln(p/(1-p))-1)))),6) as q from (select image_id, patch_no, greatest(1e-6,least(1-1e-6,score)) as p from patches)",
)
def logit_sigmoid(spark, sf):
    z = scalar.logit(F.col("score"))
    return rounded(fx.patches(spark, sf).select("image_id", "patch_no", z.alias("z"), scalar.sigmoid(2.0 * z - 1.0).alias("q")))


@query(
    "sca06_interpolation",
    ("patches",),
    """select image_id, patch_no, round(case when score<15e-2 then 5e-2 when score>=85e-2 then 9e-1 when score<5e-1 then 5e-2+(3e-1-5e-2)*(score-15e-2)/(5e-1-15e-2) else 3e-1+(9e-1-3e-1)*(score-5e-1)/(85e-2-5e-1) end,6) as q from patches""",
)
def interpolation(spark, sf):
    knots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.15, 0.05), (0.5, 0.3), (0.85, 0.9))])
    return rounded(fx.patches(spark, sf).select("image_id", "patch_no", scalar.interpolate(F.col("score"), knots).alias("q")))


@query(
    "sca07_math",
    ("tiles",),
    "select image_id, y, x, round(tanh(v),6) as tanh_v, round(ln(1+abs(v)),6) as log1p_v, round((atan2(y-35e-1,x-35e-1)+2*pi())%pi(),6) as angle, round(greatest(-1e-1,least(1e-1,v)),6) as clipped from tiles",
)
def math_functions(spark, sf):
    return rounded(
        fx.tiles(spark, sf).select(
            "image_id",
            "y",
            "x",
            F.tanh("v").alias("tanh_v"),
            F.log1p(F.abs("v")).alias("log1p_v"),
            F.pmod(F.atan2(F.col("y") - 3.5, F.col("x") - 3.5), F.pi()).alias("angle"),
            scalar.clip(F.col("v"), -0.1, 0.1).alias("clipped"),
        )
    )


@query(
    "sca08_snap_and_round",
    ("patches",),
    "select image_id, patch_no, (w::int & ~7) as snapped, (w//3)::int as third, round_even(w*5e-1,0)::int as half_even from patches",
)
def snap_and_round(spark, sf):
    w = F.col("w")
    return fx.patches(spark, sf).select(
        "image_id", "patch_no", w.cast("int").bitwiseAND(F.lit(~7)).alias("snapped"), F.expr("int(w div 3)").alias("third"), F.bround(w * 0.5).cast("int").alias("half_even")
    )


@query(
    "sca09_l2_normalised",
    ("feat",),
    "select sample_id, round(features[1]::double/n,6) as first, round(features[64]::double/n,6) as last from (select *, sqrt(list_sum(list_transform(features, lambda v: v::double*v::double))) as n from feat)",
)
def l2_normalised(spark, sf):
    unit = fx.feat(spark, sf).select("sample_id", scalar.l2_normalised(F.col("features")).alias("u"))
    return rounded(unit.select("sample_id", F.col("u")[0].alias("first"), F.col("u")[63].alias("last")))


@query("sca10_fine_minus_coarse", ("facts",), "select image_id, region_id, round(fine-coarse,6) as lead_ from facts")
def fine_minus_coarse(spark, sf):
    return rounded(region_facts(spark, sf).select("image_id", "region_id", scalar.fine_minus_coarse(F.col("scale_profile")).alias("lead_")))


@query(
    "sca11_report_json_round_trip",
    ("facts",),
    "select image_id, region_id, round(area_frac,6) as area_frac, x0, x1, round(fine,6) as fine from facts",
)
def report_json(spark, sf):
    facts = region_facts(spark, sf)
    body = F.struct("area_frac", "bbox", F.map_from_entries(F.transform(F.map_entries("scale_profile"), lambda e: F.struct(e["key"].cast("string"), e["value"]))).alias("scale_profile"))
    text = facts.select("image_id", "region_id", F.to_json(body).alias("j"))
    schema = "area_frac double, bbox struct<x0:int,y0:int,x1:int,y1:int>, scale_profile map<string,double>"
    back = text.select("image_id", "region_id", F.from_json("j", schema).alias("r"))
    return rounded(back.select("image_id", "region_id", "r.area_frac", "r.bbox.x0", "r.bbox.x1", F.element_at("r.scale_profile", "64").alias("fine")))


# --- the whole analysis -------------------------------------------------------------------

TILE_SETTINGS = analyze.Settings(
    scales=(2, 4),
    scale_floor=1,
    low=0.45,
    high=0.55,
    smoothing="guided",
    smooth_radius=1,
    region=dict(min_area_frac=0.03, grow=1, close_radius=1, halo=2, ring=2),
    report=SMALL_REPORT,
    crop_pad=1,
)


def tile_analysis(spark, sf):
    from pixelwarrant.plans.queries_grid import tile_images

    tiles = rgb(fx.tiles(spark, sf))
    cells = tiles.select("image_id", "y", "x", "luma", "r", "g", "b")
    return analyze.analyse(tile_images(spark, sf), cells, mean_scorer(fx.tiles(spark, sf)), TILE_SETTINGS, faces=qr.faces(spark, sf))


@query("analysis_tile_verdicts")
def tile_verdicts(spark, sf):
    """The full path from cells to verdicts, on every tile."""
    out = tile_analysis(spark, sf).verdicts
    return rounded(out.select("image_id", "verdict", "score", "confidence", "n_findings", "coverage", "explanation"))


def _border_scorer():
    return evidence.result(F.col("edge_straightness"), F.lit(0.4), F.array(F.lit("straight rim")))


@query(
    "udf04_registered_scorer",
    ("facts",),
    "select image_id, region_id, 'border' as specialist, round(edge_straightness,6) as probability, 4e-1 as confidence from facts",
)
def registered_scorer(spark, sf):
    """A scorer of the user's own, run by name beside the given ones."""
    named = region_facts(spark, sf).withColumn("scorers", F.array(F.lit("border")))
    out = evidence.run_scorers(named, scorers={**evidence.SCORERS, "border": _border_scorer})
    return rounded(out.select("image_id", "region_id", "specialist", "result.probability", "result.confidence"))


# --- degrade, analyse, compare --------------------------------------------------------------


def luma_scorer(cells):
    from pixelwarrant.operators import windows

    return lambda boxes: windows.window_means(boxes, cells, {"score": F.col("luma")})


cte(
    "conditioned_frames",
    """select * from (select *, floor(w*(1e0-k)/2)::int as mx, floor(h*(1e0-k)/2)::int as my from (values ('clean',1e0),('jpeg_q30',1e0),('noise_s0.05',1e0),('crop_0.8',0.8::double),('saturate_1.5',1e0)) t(severity,k),
   (select *, (max(x) over (partition by image_id)+1)::int as w, (max(y) over (partition by image_id)+1)::int as h from frames)) where x>=mx and x<w-mx and y>=my and y<h-my""",
    ("frames",),
)


@query(
    "agg34_robustness_under_degradation",
    ("conditioned_frames",),
    """select severity as condition, count(distinct image_id) as n, count(*) filter (v>=1e-1 and image_id%3=2) as truth_cells, case when severity='clean' then 1e0 end as clean_stability, true as measured from conditioned_frames group by severity""",
)
def robustness_under_degradation(spark, sf):
    """Five conditions through the whole analysis. What SQL can tell: the images of each condition, the true cells in its frame, and that clean agrees with itself."""
    from pixelwarrant.plans import robustness

    levels = {n: severities.CONDITIONS[n] for n in ("clean", "jpeg_q30", "noise_s0.05", "crop_0.8", "saturate_1.5")}
    cells, kind = colour_frames(spark, sf), F.col("image_id") % 3
    classes = cells.select("image_id").distinct().withColumn("class", F.when(kind == 0, "real").when(kind == 1, "synthetic").otherwise("tampered"))
    truth = frames(spark, sf).where((F.col("v") >= 0.1) & (kind == 2)).select("image_id", "y", "x")
    rows = robustness.analysed(cells, luma_scorer, TILE_SETTINGS, levels, classes, truth, _draws())
    rows = durable(rows)
    table = robustness.by_condition(rows)
    counts = rows.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.sum("truth_cells").alias("truth_cells"))
    inside = [F.col(c).between(0.0, 1.0) for c in ("auc_all_ai", "auc_tampered", "mean_confidence", "verdict_stability", "mean_recall", "mean_iou")]
    measured = inside[0]
    for c in inside[1:]:
        measured = measured & c
    stable = F.when(F.col("condition") == "clean", F.col("verdict_stability"))
    return table.join(counts, "condition").select("condition", "n", "truth_cells", stable.alias("clean_stability"), F.coalesce(measured, F.lit(False)).alias("measured"))
