"""Raster operators against numpy and brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelwarrant.operators import components, grid, heatmap, regions, spectral, windows


def cells(spark, images, name="v"):
    rows = [(i, int(y), int(x), float(img[y, x])) for i, img in enumerate(images) for y in range(img.shape[0]) for x in range(img.shape[1])]
    return spark.createDataFrame(rows, f"image_id long, y int, x int, {name} double")


def dense(df, name, shapes):
    out = [np.full(s, np.nan) for s in shapes]
    for r in df.select("image_id", "y", "x", name).collect():
        out[r["image_id"]][r["y"], r["x"]] = r[name]
    return out


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(0)
    return [rng.random((9, 14)), rng.random((16, 7)), rng.random((1, 5))]


def test_box_mean_small_and_large_radius(spark, images):
    for radius in (2, 20):
        got = dense(grid.box_mean(cells(spark, images), {"m": F.col("v")}, radius), "m", [i.shape for i in images])
        for img, out in zip(images, got):
            for y in range(img.shape[0]):
                for x in range(img.shape[1]):
                    part = img[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
                    assert out[y, x] == pytest.approx(part.mean(), abs=1e-9)


def test_gaussian_matches_numpy_reflection(spark, images):
    img = images[0]
    taps = np.array([w for _, w in grid.gaussian_taps(1.0)])
    pad = np.pad(img, 3, mode="reflect")
    rows = np.array([np.convolve(r, taps, "valid") for r in pad])
    want = np.array([np.convolve(c, taps, "valid") for c in rows.T]).T
    got = dense(grid.gaussian_blur(cells(spark, images), {"g": "v"}, 1.0), "g", [i.shape for i in images])[0]
    assert np.allclose(got, want, atol=1e-9)


def test_dilate_and_erode_are_dual(spark, images):
    df = cells(spark, images).withColumns({"on": F.col("v") > 0.6, "off": F.col("v") <= 0.6})
    both = grid.erode(grid.dilate(df, "off", 2, "d"), "on", 2, "e")
    assert both.where(F.col("e") == F.col("d")).isEmpty()


def flood(mask, reach):
    label, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        label[y, x] = n
        while stack:
            a, b = stack.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if reach == 4 and dy and dx:
                        continue
                    c, d = a + dy, b + dx
                    if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not label[c, d]:
                        label[c, d] = n
                        stack.append((c, d))
    return label


@pytest.mark.parametrize("reach", [4, 8])
def test_components_agree_with_flood_fill(spark, reach):
    rng = np.random.default_rng(7)
    snake = np.zeros((11, 11))
    snake[::2] = 1
    snake[1::4, -1] = 1
    snake[3::4, 0] = 1
    imgs = [(rng.random((12, 17)) < p).astype(float) for p in (0.3, 0.5, 0.6)] + [snake, np.zeros((4, 4)), np.ones((3, 3))]
    df = cells(spark, imgs).withColumn("on", F.col("v") > 0.5)
    for label in (components.label_components, components.propagate):
        got = dense(label(df, "on", reach), "component", [i.shape for i in imgs])
        for img, out in zip(imgs, got):
            assert np.array_equal(np.nan_to_num(out).astype(int), flood(img > 0.5, reach))


def test_windows_cover_everything_and_end_at_the_edge(spark):
    sizes = spark.createDataFrame([(1, 300, 200), (2, 96, 500), (3, 64, 64)], "image_id long, w int, h int")
    plan = windows.plan_windows(sizes, (64, 128, 224), 0.5)
    edge = plan.groupBy("image_id", "scale").agg(F.max("x1").alias("x"), F.max("y1").alias("y"), F.min("x0").alias("a"))
    for r in edge.collect():
        w, h = {1: (300, 200), 2: (96, 500), 3: (64, 64)}[r["image_id"]]
        assert (r["x"], r["y"], r["a"]) == (w, h, 0)
    assert plan.where("image_id = 3").count() == 1
    with pytest.raises(ValueError):
        windows.plan_windows(sizes, (64,), 1.0)


def test_constant_scores_blend_to_a_constant_map(spark):
    sizes = spark.createDataFrame([(1, 20, 13)], "image_id long, w int, h int")
    plan = windows.plan_windows(sizes, (4, 8), 0.5, floor=1).withColumn("score", F.lit(0.7))
    blended = heatmap.with_support(heatmap.blend_windows(plan))
    out = heatmap.combine_scales(blended)
    r = out.agg(F.count(F.lit(1)).alias("n"), F.min("heat").alias("a"), F.max("heat").alias("b"), F.max("disagreement").alias("d"), F.max("support").alias("s")).first()
    assert r["n"] == 260 and abs(r["a"] - 0.7) < 1e-12 and abs(r["b"] - 0.7) < 1e-12 and r["d"] < 1e-12 and r["s"] <= 1.0


def test_uncovered_scale_counts_as_half_for_the_spread_only(spark):
    rows = [(1, 2, 0, 0, 0.9, 1.0), (1, 4, 0, 0, 0.7, 1.0), (1, 2, 0, 1, 0.9, 1.0)]
    df = spark.createDataFrame(rows, "image_id long, scale int, y int, x int, heat double, support double")
    got = {r["x"]: (r["heat"], round(r["disagreement"], 9), r["support"]) for r in heatmap.combine_scales(df).collect()}
    assert got == {0: (0.9, 0.2, 1.0), 1: (0.9, 0.4, 0.5)}


def test_label_boundaries_and_thin_support(spark):
    rows = [(0.75, 1.0), (0.45, 1.0), (0.6, 1.0), (0.9, 0.1), (None, 1.0)]
    df = spark.createDataFrame(rows, "heat double, support double")
    assert [r[0] for r in df.select(heatmap.three_way_label(F.col("heat"), F.col("support"))).collect()] == [2, 0, 1, 1, 1]


def test_growth_never_enters_confident_cells(spark):
    img = np.full((7, 7), 1.0)
    img[3, 3] = 2
    img[:, 4:] = 0
    grown = regions.grown_mask(cells(spark, [img], "label"), 2, 1)
    out = dense(grown.withColumn("g", F.col("grown").cast("double")), "g", [(7, 7)])[0]
    assert out[:, 4:].sum() == 0 and out[3, 1] == 1


def test_mask_metrics_edge_cases(spark):
    df = spark.createDataFrame([("same", True, True), ("same", False, False), ("apart", True, False), ("apart", False, True), ("empty", False, False)], "image_id string, p boolean, t boolean")
    got = {r["image_id"]: (r["iou"], r["precision"], r["recall"], r["f1"]) for r in regions.mask_metrics(df, F.col("p"), F.col("t")).collect()}
    assert got == {"same": (1, 1, 1, 1), "apart": (0, 0, 0, 0), "empty": (0, 0, 0, 0)}


def test_block_round_trip_and_flat_image(spark):
    flat = np.full((8, 8), 0.4)
    shape = spectral.residual_shape(grid.residual(cells(spark, [flat]), "v", "res")).first()
    assert (shape["res_std"], shape["res_skew"], shape["res_kurtosis"]) == (0, 0, 0)
    rng = np.random.default_rng(2)
    img = rng.random((16, 12))
    mse = []
    for step in (0.01, 0.1, 0.5):
        ela = dense(spectral.error_level(cells(spark, [img]), "v", step), "ela", [img.shape])[0]
        filled = np.pad(img, ((0, 0), (0, 4)), mode="edge")
        basis = spectral._dct_basis()
        for y in (0, 8):
            for x in (0, 8):
                back = basis.T @ (np.rint(basis @ filled[y : y + 8, x : x + 8] @ basis.T / step) * step) @ basis
                assert ela[y : y + 8, x : x + 8] == pytest.approx(abs(filled[y : y + 8, x : x + 8] - back)[:, : 12 - x], abs=1e-9)
        mse.append(np.mean(ela**2))
    assert mse[0] < mse[1] < mse[2]


def test_loss_grows_with_severity(spark):
    from pixelwarrant.operators import degrade

    rng = np.random.default_rng(1)
    df = cells(spark, [rng.random((16, 16))])
    levels = {"clean": [], "b1": [("blur", 0.5)], "b2": [("blur", 2.0)], "n1": [("noise", 0.02)], "n2": [("noise", 0.1)], "j1": [("jpeg", 90)], "j2": [("jpeg", 30)]}
    out = degrade.degrade(df, "v", levels).join(df.withColumnRenamed("v", "w"), ["image_id", "y", "x"])
    mse = {r["severity"]: r["m"] for r in out.groupBy("severity").agg(F.avg((F.col("v") - F.col("w")) ** 2).alias("m")).collect()}
    assert mse["clean"] == 0 and mse["b1"] < mse["b2"] and mse["n1"] < mse["n2"] and mse["j1"] < mse["j2"]


@pytest.mark.parametrize("connectivity", [4, 8])
def test_tiled_components_are_those_of_the_whole_frame(spark, connectivity):
    rng = np.random.default_rng(connectivity)
    snake = np.zeros((26, 31), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True  # one component through every tile
    masks = [rng.random((33, 29)) < 0.45, snake, np.zeros((4, 4), bool), np.ones((17, 23), bool)]
    rows = [(i, y, x, bool(m[y, x])) for i, m in enumerate(masks) for y in range(m.shape[0]) for x in range(m.shape[1])]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, on boolean")
    key = lambda d: sorted(tuple(r) for r in d.select("image_id", "y", "x", "component").collect())
    whole = key(components.label_components(df, "on", connectivity))
    for tile in (7, 64):
        assert key(components.label_tiled(df, "on", tile, connectivity)) == whole
    assert max(c for i, _, _, c in whole if i == 1) == 1


def test_whole_frames_degrade_like_cells(spark):
    """Whole frames go through the steps packed, without windows over cells; frames with a gap, a null or a cell twice give what cells give."""
    from pixelwarrant.operators import degrade, severities

    rng = np.random.default_rng(4)
    rows = [(i, y, x, *map(float, rng.random(3))) for i, (h, w) in enumerate([(7, 21), (7, 21), (9, 5), (1, 3), (8, 16), (6, 6)]) for y in range(h) for x in range(w)]
    rows = [r for r in rows if r[:3] != (1, 3, 4)] + [(5, 5, 5, 0.1, 0.2, 0.3)]
    rows = [(*r[:3], None, *r[4:]) if r[:3] == (4, 2, 2) else r for r in rows]
    cells = spark.createDataFrame(rows, "image_id long, y int, x int, r double, g double, b double")
    names = ("clean", "blur_s1.0", "center_crop_80pct", "compound_moderate")
    levels = {n: severities.SEVERITIES[n] for n in names} | {n: severities.CONDITIONS[n] for n in ("crop_0.8", "saturate_1.5", "noise_s0.05")}

    def table(df):
        return sorted(((r.image_id, r.severity, r.y, r.x), (r.r, r.g, r.b)) for r in df.collect() if r.image_id not in (4, 5))

    whole = degrade.degrade(cells.where("image_id in (0, 2, 3)"), ("r", "g", "b"), levels)
    assert "Window" not in whole._jdf.queryExecution().executedPlan().toString()
    got, want = table(degrade.degrade(cells, ("r", "g", "b"), levels)), table(degrade._by_cells(cells, ("r", "g", "b"), levels, degrade.HASHED))
    assert len({k for k, _ in got}) == len(got) and [k for k, _ in got] == [k for k, _ in want]
    assert np.allclose([v for _, v in got], [v for _, v in want], atol=1e-9)
    kinds = {r.image_id for r in degrade._packed(cells, ("r", "g", "b"), levels, degrade.HASHED).where("not _whole").collect()}
    assert kinds == {1, 4, 5}


def test_degradations_travel_after_a_column_function_was_used(spark):
    """A column function that a session has used holds what can't be pickled; what tasks run may not take its module along."""
    from pixelwarrant.operators import degrade, spectral

    spark.range(1).select(spectral.block_dct(F.array_repeat(F.lit(1.0), 64))).collect()
    cells = spark.createDataFrame([(0, y, x, 0.01 * (8 * y + x)) for y in range(8) for x in range(8)], "image_id long, y int, x int, v double")
    levels = {"jpeg": [("jpeg", 30.0)], "blur": [("blur", 1.0)]}
    assert degrade.degrade(cells, "v", levels).count() == 128


def test_measured_cells_of_whole_and_torn_frames(spark):
    """Blurs and error levels come from packed frames: nothing is joined, a gap moves the cells of its line together, a null spreads as far as the taps reach."""
    from pixelwarrant.operators import forensics

    rng = np.random.default_rng(8)
    rows = [(i, y, x, float(rng.random()), "kept") for i, (h, w) in enumerate([(8, 8), (9, 13), (8, 8), (8, 8)]) for y in range(h) for x in range(w)]
    rows = [r for r in rows if r[:3] != (2, 0, 3)]
    rows = [(*r[:3], None, r[4]) if r[:3] == (3, 4, 4) else r for r in rows]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, v double, note string").withColumns({c: F.col("v") for c in "rgb"})
    out = forensics.measured_cells(df, "v")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.image_id, r.y, r.x): r for r in out.collect()}
    assert len(got) == len(rows) and {r.note for r in got.values()} == {"kept"}
    taps = dict(grid.gaussian_taps(1.0))
    mirror = lambda i, n: (lambda m: m if m < n else 2 * (n - 1) - m)(i % (2 * (n - 1)))
    v = {r[:3]: r[3] for r in rows}
    # A torn row is one cell shorter; then each column is blurred over the cells it has.
    line = {y: [v[2, y, x] for x in range(8) if (2, y, x) in v] for y in range(8)}
    row = {(y, x): sum(w * line[y][mirror(i + k, len(line[y]))] for k, w in taps.items()) for y in range(8) for i, x in enumerate(x for x in range(8) if (2, y, x) in v)}
    for y, x in row:
        column = [row[j, x] for j in range(8) if (j, x) in row]
        at = [j for j in range(8) if (j, x) in row].index(y)
        assert abs(v[2, y, x] - got[2, y, x].res - sum(w * column[mirror(at + k, len(column))] for k, w in taps.items())) < 1e-12
        assert got[2, y, x].ela is None and got[0, y, x].ela is not None
    assert got[3, 0, 0].res is not None and got[3, 4, 2].res is None and got[3, 1, 1].res is None and got[1, 8, 12].ela is not None
