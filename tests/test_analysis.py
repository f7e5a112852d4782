"""The whole path on made images, and the rules behind it."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelwarrant.operators import evidence, fusion, regions, routing, windows
from pixelwarrant.plans.analyze import Settings, analyse
from pixelwarrant.sources import images

CELL = 8


def picture(square):
    rng = np.random.default_rng(0)
    y, x = np.mgrid[0:512, 0:512]
    noise = rng.normal(0, 9, (512, 512, 3))
    if square:
        noise[160:352, 160:352] *= 0.12
    base = 90 + 40 * (x + y)[..., None] / 1024
    return np.clip(base + noise, 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def analysed(spark):
    rows = [(i, 512, 512, 3, bytearray(picture(s)[:, :, ::-1].tobytes())) for i, s in ((1, True), (2, False))]
    raw = spark.createDataFrame(rows, "image_id long, height int, width int, nChannels int, data binary")
    cells = images.image_cells(raw, CELL).withColumn("luma", images.luma()).cache()
    sizes = spark.createDataFrame([(1, 64, 64), (2, 64, 64)], "image_id long, w int, h int")
    scorer = lambda boxes: windows.smoothness_scores(boxes, cells, F.col("luma") * 255, full_scale=1.7)
    settings = Settings(
        scales=(8, 16, 28),
        high=0.6,
        smooth_radius=1,
        region=dict(min_area_frac=0.004, grow=1, close_radius=1, halo=2, ring=2, max_regions=8),
        crop_pad=1,
    )
    return analyse(sizes, cells, scorer, settings)


def test_the_edit_is_found_where_it_is(analysed):
    found = analysed.regions.where("image_id = 1").orderBy(F.col("area_px").desc()).first()
    b = found["bbox"]
    inter = max(0, min(b["x1"], 44) - max(b["x0"], 20)) * max(0, min(b["y1"], 44) - max(b["y0"], 20))
    union = (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) + 24 * 24 - inter
    assert inter / union > 0.55


def test_the_clean_image_raises_nothing(analysed):
    verdicts = {r["image_id"]: r for r in analysed.verdicts.collect()}
    assert analysed.regions.where("image_id = 2").count() == 0
    assert verdicts[2]["verdict"] == "likely_authentic" and verdicts[2]["n_findings"] == 0
    assert verdicts[1]["verdict"] in ("ai_edited", "manipulated_not_necessarily_ai", "ai_generated")
    assert verdicts[1]["confidence"] <= 0.60 and verdicts[1]["score"] > verdicts[2]["score"]
    assert "whole-image score" in verdicts[2]["explanation"]


def test_report_is_nested_and_complete(analysed):
    report = fusion.nested_report(analysed.verdicts, analysed.findings, F.lit(float(CELL)))
    rows = {r["image_id"]: r for r in report.collect()}
    assert len(rows[1]["regions"]) >= 1 and rows[2]["regions"] == []
    assert rows[1]["regions"][0]["bbox_original"][0] % CELL == 0


def region(spark, **over):
    base = dict(
        image_id=1, region_id=1, area_frac=0.1, mean_score=0.9, support=0.6, scale_disagreement=0.05, boundary_sharpness=0.0,
        fill_ratio=0.5, face_overlap=None, scale_profile={64: 0.8, 224: 0.8},
    )
    base.update(over)
    schema = (
        "image_id long, region_id int, area_frac double, mean_score double, support double, scale_disagreement double,"
        " boundary_sharpness double, fill_ratio double, face_overlap double, scale_profile map<int,double>"
    )
    return spark.createDataFrame([tuple(base.values())], schema)


@pytest.mark.parametrize(
    "change, primary",
    [
        ({"face_overlap": 0.5, "area_frac": 0.9}, "face_edit"),
        ({"area_frac": 0.7}, "synthesis"),
        ({"mean_score": 0.5}, "fallback"),
        ({"support": 0.1}, "fallback"),
        ({"scale_disagreement": 0.4}, "fallback"),
        ({"scale_disagreement": 0.4, "scale_profile": {64: 0.9, 224: 0.5}, "boundary_sharpness": 0.05}, "inpainting"),
        ({"fill_ratio": 0.95}, "compositing"),
        ({"boundary_sharpness": 0.05}, "compositing"),
        ({}, "inpainting"),
    ],
)
def test_router_rules_in_order(spark, change, primary):
    assert routing.with_route(region(spark, **change)).first()["route"]["primary"] == primary


def findings(spark, rows):
    schema = (
        "image_id long, region_id int, area_frac double, probability double, confidence double, label string,"
        " route struct<primary:string,alternates:array<string>,reason:string>, bbox struct<x0:int,y0:int,x1:int,y1:int>, evidence array<string>"
    )
    return spark.createDataFrame([(1, i, a, p, c, l, (r, [], "because"), (0, 0, 1, 1), ["seen"]) for i, (a, p, c, l, r) in enumerate(rows, 1)], schema)


def judge(spark, rows, whole, uncertain=0.0, support=1.0, calibrated=True):
    image = spark.createDataFrame([(1, whole, uncertain, support)], "image_id long, whole_image_score double, frac_uncertain double, mean_support double")
    return fusion.fuse_images(image, findings(spark, rows), calibrated).first()


def test_verdict_follows_the_winning_hypothesis(spark):
    edit = (0.1, 0.9, 0.8, "generative_edit", "inpainting")
    plain = (0.1, 0.9, 0.8, "conventional_manipulation", "compositing")
    assert judge(spark, [edit], 0.2)["verdict"] == "ai_edited"
    assert judge(spark, [edit], 0.99)["verdict"] == "ai_generated"
    assert judge(spark, [plain], 0.2)["verdict"] == "manipulated_not_necessarily_ai"
    assert judge(spark, [(0.6, 0.9, 0.8, "generated_content", "synthesis")], 0.2)["verdict"] == "ai_generated"
    assert judge(spark, [], 0.1)["verdict"] == "likely_authentic"
    assert judge(spark, [], 0.5, uncertain=1.0, support=0.1)["verdict"] == "uncertain"


def test_regions_combine_as_independent_evidence(spark):
    one = judge(spark, [(0.1, 0.8, 0.8, "generative_edit", "inpainting")], 0.0)
    two = judge(spark, [(0.1, 0.8, 0.8, "generative_edit", "inpainting")] * 2, 0.0)
    e = 0.6 * (0.4 + 0.6 * 0.8)
    assert one["local_score"] == pytest.approx(0.5 + 0.5 * e)
    assert two["local_score"] == pytest.approx(0.5 + 0.5 * (1 - (1 - e) ** 2))
    assert two["verdict"] == "ai_edited" and two["routed_to"] == ["inpainting", "inpainting"]


def test_uncalibrated_confidence_is_capped(spark):
    rows = [(0.1, 0.9, 0.95, "generative_edit", "inpainting")]
    free, capped = judge(spark, rows, 0.0), judge(spark, rows, 0.0, calibrated=False)
    assert free["confidence"] > 0.6 and capped["confidence"] == 0.6 and capped["capped_by_calibration"]
    assert capped["uncapped_confidence"] == pytest.approx(free["confidence"])


def fused(spark, results, mean=0.7, support=0.6, spread=0.0):
    schema = (
        "image_id long, region_id int, mean_score double, support double, scale_disagreement double,"
        " route struct<primary:string,alternates:array<string>,reason:string>, specialist string,"
        " result struct<probability:double,confidence:double,evidence:array<string>,kind:string>"
    )
    rows = [(1, 1, mean, support, spread, ("inpainting", [], ""), n, (p, c, ["e"], None)) for n, p, c in results]
    return fusion.fuse_regions(spark.createDataFrame(rows, schema)).first()


def test_shrinkage_and_ceiling(spark):
    assert fused(spark, [("inpainting", 0.9, 0.0)])["probability"] == pytest.approx(0.7)
    agree = fused(spark, [("inpainting", 0.9, 0.6), ("compositing", 0.9, 0.6)])
    differ = fused(spark, [("inpainting", 0.9, 0.6), ("compositing", 0.1, 0.6)])
    assert differ["specialist_conf"] < agree["specialist_conf"]
    thin = fused(spark, [("inpainting", 1.0, 1.0)], support=0.0, spread=1.0)
    assert thin["probability"] == pytest.approx(0.675) and any("capped" in e for e in thin["evidence"])


def test_unknown_scorer_is_an_error(spark):
    assert evidence.unknown_scorers(["inpainting", "magic"]) == ["magic"]


def test_face_must_cover_enough(spark):
    cells = spark.createDataFrame([(1, 1, y, x) for y in range(4) for x in range(4)], "image_id long, region_id int, y int, x int")
    found = spark.createDataFrame(
        [(1, 1, (0, 0, 4, 4), 16)], "image_id long, region_id int, bbox struct<x0:int,y0:int,x1:int,y1:int>, area_px int"
    )
    faces = spark.createDataFrame([(1, 0, 0, 1, 4), (1, 0, 0, 3, 4)], "image_id long, x0 int, y0 int, x1 int, y1 int")
    got = regions.match_faces(found, cells, faces).first()
    assert got["face_overlap"] == 0.75 and got["face"]["x1"] == 3
    assert regions.match_faces(found, cells, faces.where("x1 = 1")).count() == 0


def test_large_images_are_brought_to_their_working_size(spark):
    from pixelwarrant.operators import grid
    from pixelwarrant.plans import analyze

    rng = np.random.default_rng(0)
    shapes = {1: (12, 20), 2: (6, 8)}
    rows = [(i, y, x, *map(float, rng.random(4))) for i, (h, w) in shapes.items() for y in range(h) for x in range(w)]
    cells = spark.createDataFrame(rows, "image_id long, y int, x int, luma double, r double, g double, b double")
    images = spark.createDataFrame([(i, w, h) for i, (h, w) in shapes.items()], "image_id long, w int, h int")
    faces = spark.createDataFrame([(1, 4, 2, 16, 12), (2, 1, 1, 4, 4)], "image_id long, x0 int, y0 int, x1 int, y1 int")
    sizes, made, boxes = analyze.bounded(images, cells, faces, 10)
    assert {tuple(r) for r in sizes.collect()} == {(1, 10, 6), (2, 8, 6)}
    assert {tuple(r) for r in boxes.select("image_id", "x0", "y0", "x1", "y1").collect()} == {(1, 2, 1, 8, 6), (2, 1, 1, 4, 4)}
    wanted = grid.resample_bilinear(cells.where("image_id = 1"), ["luma", "b"], F.lit(10), F.lit(6))
    one = lambda df: {(r["y"], r["x"]): (round(r["luma"], 9), round(r["b"], 9)) for r in df.collect()}
    assert one(made.where("image_id = 1")) == one(wanted)
    assert one(made.where("image_id = 2")) == one(cells.where("image_id = 2"))
    same = analyze.bounded(images, cells, faces, 20)
    assert same[1] is cells


def test_windows_of_an_image_share_a_partition_and_partitions_grow_in_number(spark, sf):
    """Regions are grouped again where they are; a partition's size does not grow with the table."""
    from pixelwarrant.plans import queries_evidence as qe
    from pixelwarrant.session import spread

    rows = spark.range(1000).withColumn("k", F.col("id") % 100)
    parts = spread(rows, "k", 1000, per_task=20)
    assert parts.rdd.getNumPartitions() == 50
    assert parts.select("k", F.spark_partition_id().alias("p")).distinct().count() == 100
    plan = qe.findings(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
