"""Views over the given tables that stand for scores, windows, tiny images and features.

Each view exists twice: as a DataFrame and as the SQL text the oracle runs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelwarrant.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def arms(spark: SparkSession, sf: str) -> DataFrame:
    """Two paired scores per labelled item, with many ties."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("family"),
        "lang",
        F.col("quality").alias("y"),
        ((F.col("doc_id") * 7919) % 100 / F.lit(200.0) + F.col("quality") * F.lit(0.3)).alias("p_with"),
        ((F.col("doc_id") * 104729) % 100 / F.lit(100.0)).alias("p_without"),
    )


def patches(spark: SparkSession, sf: str) -> DataFrame:
    """Scored windows of three classes and three scales; the windows of an image share a partition."""
    lines = table(spark, sf, "lineitem")
    items = spread(lines.select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_partkey", "l_suppkey"), "l_orderkey", lines.count())
    return (
        items.groupBy("l_orderkey", "l_linenumber")
        .agg(
            (F.max("l_discount") * 10.0).alias("score"),
            (F.min("l_tax") * 10.0).alias("score2"),
            (64 + F.max("l_partkey") % 1000).alias("w"),
            (64 + (F.max("l_suppkey") * 37) % 800).alias("h"),
        )
        .select(
            F.col("l_orderkey").alias("image_id"),
            F.col("l_linenumber").alias("patch_no"),
            F.when(F.col("l_orderkey") % 3 == 0, "real")
            .when(F.col("l_orderkey") % 3 == 1, "synthetic")
            .otherwise("tampered")
            .alias("class"),
            F.when(F.col("l_linenumber") % 3 == 0, 64)
            .when(F.col("l_linenumber") % 3 == 1, 128)
            .otherwise(224)
            .alias("scale"),
            "score",
            "score2",
            "w",
            "h",
        )
    )


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Each 64-float vector read as an 8x8 image; heat is that image shifted into [0, 1]."""
    cells = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "f")
    )
    v = F.col("f").cast("double")
    return cells.select(
        "image_id",
        F.expr("int(pos div 8)").alias("y"),
        (F.col("pos") % 8).cast("int").alias("x"),
        v.alias("v"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), v + 0.5)).alias("heat"),
    )


def feat(spark: SparkSession, sf: str) -> DataFrame:
    """A feature table with one augmented copy per image."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.expr("vec_id div 2").alias("group_id"),
        F.when(F.col("label") >= 5, 1).otherwise(0).alias("y"),
        (F.col("vec_id") % 2 == 1).alias("is_aug"),
        (F.col("label") % 3).alias("family"),
        F.col("embedding").alias("features"),
    )


def eval_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One evaluation record per scored item, with the fields an evaluation run stores."""
    p = patches(spark, sf)
    k = F.col("w") * 31 + F.col("h") * 17
    iou = (F.col("w") * 7 + F.col("h") * 3) % 101
    recall = (F.col("w") * 11 + F.col("h")) % 101
    names = F.array(*[F.lit(n) for n in ("inpainting", "compositing", "fallback", "synthesis", "face_edit")])
    return p.select(
        (F.col("image_id") * 10 + F.col("patch_no")).alias("stem"),
        "class",
        (F.col("class") != "real").cast("int").alias("label"),
        "score",
        F.col("score2").alias("whole_image_score"),
        F.element_at(
            F.array(
                *[
                    F.lit(n)
                    for n in (
                        "ai_generated",
                        "ai_edited",
                        "manipulated_not_necessarily_ai",
                        "likely_authentic",
                        "likely_authentic_with_open_questions",
                        "uncertain",
                    )
                ]
            ),
            (k % 6 + 1).cast("int"),
        ).alias("verdict"),
        (k % 100 / F.lit(100.0)).alias("confidence"),
        (k % 4).cast("int").alias("n_regions"),
        F.slice(
            F.concat(names, names), (F.col("w") % 5 + 1).cast("int"), (k % 4).cast("int")
        ).alias("routed_to"),
        (F.col("h") % 100 / F.lit(100.0)).alias("pred_area_frac"),
        (F.col("w") % 50 / F.lit(10.0)).alias("seconds"),
        F.when(
            F.col("class") == "tampered",
            F.struct(
                (iou / F.lit(100.0)).alias("iou"),
                (F.col("w") % 101 / F.lit(100.0)).alias("precision"),
                (recall / F.lit(100.0)).alias("recall"),
                (F.col("h") % 101 / F.lit(100.0)).alias("f1"),
                ((F.col("h") * F.col("h")) % 400 / F.lit(1000.0)).alias("true_area_frac"),
            ),
        ).alias("localisation"),
    )


FIXTURE_SQL: dict[str, str] = {
    "arms": """select l.doc_id as id, d.source as family, d.lang, l.quality as y,
  ((l.doc_id*7919)%100)/2e2 + l.quality*3e-1 as p_with, ((l.doc_id*104729)%100)/1e2 as p_without
  from labels l join documents d on l.doc_id=d.doc_id""",
    "patches": """select l_orderkey as image_id, l_linenumber as patch_no,
  case l_orderkey%3 when 0 then 'real' when 1 then 'synthetic' else 'tampered' end as class,
  case l_linenumber%3 when 0 then 64 when 1 then 128 else 224 end as scale,
  max(l_discount)*1e1 as score, min(l_tax)*1e1 as score2,
  64+max(l_partkey)%1000 as w, 64+(max(l_suppkey)*37)%800 as h
  from lineitem group by l_orderkey,l_linenumber""",
    "tiles": """select image_id, (pos//8)::int as y, (pos%8)::int as x, v,
  greatest(0e0,least(1e0,5e-1+v)) as heat
  from (select vec_id as image_id, generate_subscripts(embedding,1)-1 as pos,
        unnest(embedding)::double as v from embeddings)""",
    "feat": """select vec_id as sample_id, vec_id//2 as group_id, case when label>=5 then 1 else 0 end as y,
  (vec_id%2=1) as is_aug, label%3 as family, embedding as features from embeddings""",
    "eval_rows": """select image_id*10+patch_no as stem, class, (class<>'real')::int as label, score,
  score2 as whole_image_score,
  (['ai_generated','ai_edited','manipulated_not_necessarily_ai','likely_authentic',
    'likely_authentic_with_open_questions','uncertain'])[((w*31+h*17)%6+1)::int] as verdict,
  ((w*31+h*17)%100)/1e2 as confidence, ((w*31+h*17)%4)::int as n_regions,
  (['inpainting','compositing','fallback','synthesis','face_edit','inpainting','compositing','fallback','synthesis','face_edit'])
    [(w%5+1)::int:(w%5+(w*31+h*17)%4)::int] as routed_to,
  (h%100)/1e2 as pred_area_frac, (w%50)/1e1 as seconds,
  case when class='tampered' then ((w*7+h*3)%101)/1e2 end as iou,
  case when class='tampered' then (w%101)/1e2 end as prec,
  case when class='tampered' then ((w*11+h)%101)/1e2 end as recall,
  case when class='tampered' then (h%101)/1e2 end as f1,
  case when class='tampered' then ((h*h)%400)/1e3 end as true_area_frac
  from patches""",
}

FIXTURE_NEEDS: dict[str, tuple[str, ...]] = {"eval_rows": ("patches",)}
