"""Image files, archives, tables and streams on generated folders."""
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelwarrant.functions import udfs
from pixelwarrant.operators import calibration, labels
from pixelwarrant.sources import images, tables
from pixelwarrant.streaming import jobs


def png(path, rgb):
    """A minimal truecolour PNG."""
    h, w, _ = rgb.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    )


@pytest.fixture(scope="module")
def lake(tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    rng = np.random.default_rng(0)
    for i, side in enumerate(("real", "fake", "real")):
        png(root / "set_a" / side / f"{i}.png", rng.integers(0, 255, (6, 9, 3)))
    (root / "set_a" / "fake" / "broken.PNG").write_bytes(b"not an image")
    (root / "set_a" / "fake" / "notes.txt").write_text("x")
    return root


def test_listing_labels_and_decode_errors(spark, lake):
    listed = images.list_images(spark, str(lake))
    assert listed.count() == 4
    found = images.label_by_folder(listed)
    assert {(r["dataset"], r["label"]) for r in found.collect()} == {("set_a", 0), ("set_a", 1)}
    decoded = images.read_images(spark, str(lake))
    assert decoded.count() == 3
    assert [r["path"].split("/")[-1] for r in images.decode_errors(listed, decoded).collect()] == ["broken.PNG"]


def test_empty_folder_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no images"):
        images.unlabelled_folder(spark, str(tmp_path))


def test_pixels_keep_channel_order_and_block_means(spark, tmp_path):
    rgb = np.zeros((4, 6, 3), int)
    rgb[..., 0], rgb[..., 2] = 200, 10
    rgb[:2, :3, 1] = 100
    png(tmp_path / "one.png", rgb)
    decoded = images.read_images(spark, str(tmp_path)).withColumn("image_id", F.lit(1).cast("long"))
    px = images.image_cells(decoded)
    assert px.count() == 24 and px.where("r = 200 and b = 10").count() == 24 and px.where("g = 100").count() == 6
    blocks = {(r["y"], r["x"]): r["g"] for r in images.image_cells(decoded, 4).collect()}
    assert blocks == {(0, 0): pytest.approx(100 * 6 / 16), (0, 1): 0.0}


def test_archive_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("cat/0_real/1.png", "cat/1_fake/2.jpg", "dog/0_real/3.PNG", "dog/readme.txt", "x/other/4.png"):
            z.writestr(name, b"data")
    got = images.archive_members(spark, str(tmp_path)).collect()
    assert sorted((r["category"], r["label"]) for r in got) == [("cat", 0), ("cat", 1), ("dog", 0)]
    assert all(bytes(r["content"]) == b"data" for r in got)


def test_relabelling_is_case_blind_and_free_of_collisions(spark):
    paths = spark.createDataFrame([("/d/train/REAL/1.png",), ("/d/test/real/1.png",), ("/d/train/Fake/1.png",), ("/d/x/1.png",)], "path string")
    one = images.relabel_layout(paths.where("path like '%train%'"), "train")
    two = images.relabel_layout(paths.where("path like '%test%'"), "test")
    assert sorted(r["dest"] for r in one.union(two).collect()) == ["fake/train_1.png", "real/test_1.png", "real/train_1.png"]


def test_payload_struct_or_bytes(spark, tmp_path):
    raw = spark.createDataFrame([(bytearray(b"ab"),), (None,)], "image binary")
    raw.write.parquet(f"{tmp_path}/raw")
    raw.select(F.struct(F.col("image").alias("bytes"), F.lit("p").alias("path")).alias("image")).write.parquet(f"{tmp_path}/nested")
    for name in ("raw", "nested"):
        assert [bytes(r[0]) for r in tables.read_payloads(spark, f"{tmp_path}/{name}", "image").collect()] == [b"ab"]


def test_feature_tables_refuse_a_mix(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0, False, 0, [0.1, 0.2])], "sample_id long, group_id long, y int, is_aug boolean, family int, features array<float>")
    tables.write_features(rows, f"{tmp_path}/a", [("x", 2)], "v1")
    tables.write_features(rows, f"{tmp_path}/b", [("x", 1), ("z", 1)], "v1")
    assert tables.read_features(spark, f"{tmp_path}/a").count() == 1
    with pytest.raises(ValueError, match="different"):
        tables.require_same_signature(tables.read_blocks(spark, f"{tmp_path}/a"), tables.read_blocks(spark, f"{tmp_path}/b"))
    with pytest.raises(FileNotFoundError):
        tables.read_features(spark, f"{tmp_path}/none")


def test_shard_slice_bounds():
    assert tables.shard_slice(["b", "a", "c"], 1) == ["b", "c"]
    with pytest.raises(ValueError):
        tables.shard_slice(["a"], 1)


def test_sinks_write_what_they_are_given(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.2), ("b", 0.7)], "p string, s double")
    tables.write_json(tables.predictions(rows, F.col("p"), F.col("s"), F.lit(0.5)), f"{tmp_path}/j")
    assert sorted((r["image_path"], r["label"]) for r in spark.read.json(f"{tmp_path}/j").collect()) == [("a", 0), ("b", 1)]
    tables.append_manifest(rows, f"{tmp_path}/m")
    tables.append_manifest(rows, f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").count() == 4


def test_calibrator_documents(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"kind": "platt", "params": {"a": 1.5, "b": 0.1}, "fitted": true}')
    (tmp_path / "many.json").write_text(
        '{"kind": "per_scale", "shared": {"kind": "identity", "params": {}, "fitted": false},'
        ' "scales": {"64": {"kind": "isotonic", "params": {"x": [0.0, 1.0], "y": [0.2, 0.8]}, "fitted": true}}}'
    )
    one = calibration.load_document(spark, str(tmp_path / "one.json")).collect()
    assert [(r["scale"], r["kind"], r["a"]) for r in one] == [(None, "platt", 1.5)]
    many = calibration.load_document(spark, str(tmp_path / "many.json"))
    assert {(r["scale"], r["kind"]) for r in many.collect()} == {(None, "identity"), (64, "isotonic")}
    scored = spark.createDataFrame([(64, 0.5), (128, 0.3), (64, None)], "scale int, score double")
    got = [r["score"] for r in calibration.calibrated(scored, many).collect()]
    assert got == [pytest.approx(0.5), pytest.approx(0.3), None]


def test_class_names_are_never_guessed(spark):
    rows = [(1, {0: "Fake", 1: "Real"}), (2, {0: "human", 1: "AI-generated"}), (3, {0: "not_ai", 1: "real"}), (4, {0: "label_0", 1: "real"}), (5, {0: "gan", 1: "sdxl"})]
    got = {r["m"]: (r["positive"], r["error"]) for r in labels.resolve_positive(spark.createDataFrame(rows, "m int, l map<int,string>"), "m", "l").collect()}
    assert got[1] == ([0], None) and got[2] == ([1], None)
    assert got[3] == (None, "no AI class") and got[4] == (None, "unrecognised label") and got[5] == (None, "no real class")


def test_windows_of_a_model_are_not_shuffled_by_it(spark):
    probs = spark.range(2000).selectExpr("cast(id % 2 as int) as m", "id div 4 as k", "cast(id div 2 % 2 as int) as id", "0.25D as p").repartition(4, "k")
    models = spark.createDataFrame([(0, {0: "fake", 1: "real"}), (1, {0: "fake", 1: "ai", 2: "real"})], "m int, l map<int,string>")
    out = labels.positive_probability(probs, labels.resolve_positive(models, "m", "l"), "m", ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(m" not in plan.split("BroadcastExchange")[0]
    assert sorted((r["m"], r["score"]) for r in out.collect()) == [(0, 0.25)] * 500 + [(1, 0.5)] * 500


def test_scorer_length_is_checked(spark):
    rows = spark.range(10).toDF("id")
    bad = udfs.score_patches(rows, lambda: (lambda batch: [0.5]), ["id"])
    with pytest.raises(Exception, match="returned 1 scores"):
        bad.coalesce(1).collect()


def test_images_are_scored_once_as_they_arrive(spark, lake, tmp_path):
    def scorer(files):
        return files.select("path", (F.octet_length("content") / 1000.0).alias("pred"))

    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    jobs.score_arriving_images(spark, str(lake), scorer, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 4
    jobs.score_arriving_images(spark, str(lake), scorer, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_one_archive_is_many_tasks(spark, tmp_path):
    from pixelwarrant.sources import files

    rng = np.random.default_rng(0)
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        for i in range(60):
            z.writestr(f"cat/{i % 2}_{'fake' if i % 2 else 'real'}/{i}.png", rng.bytes(3000))
        z.writestr("cat/0_real/", b"")
    members = files.archive_members(spark, str(tmp_path), range_bytes="20000")
    assert members.rdd.getNumPartitions() >= 9
    with zipfile.ZipFile(tmp_path / "big.zip") as z:
        wanted = {n: z.read(n) for n in z.namelist() if not n.endswith("/")}
    assert {r["member"]: bytes(r["content"]) for r in members.collect()} == wanted
    names = files.archive_members(spark, str(tmp_path / "big.zip"), content="false", suffixes="png, jpg")
    assert names.where("content is null and length = 3000").count() == 60
    labelled = images.archive_members(spark, str(tmp_path))
    assert labelled.groupBy("label").count().where("count = 30").count() == 2
    images.require_both_sides(labelled)
    with pytest.raises(ValueError, match="without both"):
        images.require_both_sides(labelled.where("label = 1"))


def test_small_ranges_share_tasks():
    from pixelwarrant.sources import files

    zips = [(f"{i}.zip", 1000 * i) for i in range(3000)]
    tasks = files.packed(zips, 1 << 14)
    assert len(tasks) <= 1.2 * (sum(n for _, n in zips) // files.TASK_BYTES + 1) + files.TASKS
    for path, size in zips[::97]:  # every byte of an archive once, and one range of it in a task
        own = [r for t in tasks for r in t if r[0] == path]
        assert own[0][1] == 0 and own[-1][2] >= size and all(a[2] == b[1] for a, b in zip(own, own[1:]))
        assert all(sum(r[0] == path for r in t) <= 1 for t in tasks)
    assert files.packed([], 5) == [] and files.packed([("a", 11)], 5) == [[("a", 0, 5)], [("a", 5, 10)], [("a", 10, 15)]]


def test_archives_and_files_are_written_whole(spark, tmp_path):
    from pixelwarrant.sources import files

    rows = [(i % 3, f"a/0_real/{i}.png", bytes([i]) * i) for i in range(40)]
    df = spark.createDataFrame(rows, "archive int, member string, content binary").repartition(5)
    assert files.write_archives(df, f"{tmp_path}/zips") == 3
    back = files.archive_members(spark, f"{tmp_path}/zips").collect()
    assert sorted((int(r["archive"].split("/")[-1][:-4]), r["member"], bytes(r["content"])) for r in back) == sorted((a, m, bytes(c)) for a, m, c in rows)
    assert files.write_files(df.select(F.col("member").alias("path"), "content"), f"{tmp_path}/files") == 40
    assert (tmp_path / "files" / "a" / "0_real" / "7.png").read_bytes() == bytes([7]) * 7
    assert not [p for p in tmp_path.rglob("*.part")]
    assert files.write_archives(df.limit(0), f"{tmp_path}/none") == 0


def test_pictures_keep_their_channels(spark, tmp_path):
    from pixelwarrant.sources import files

    rng = np.random.default_rng(1)
    px = {"grey.png": rng.integers(0, 255, (3, 5, 1)), "colour.png": rng.integers(0, 255, (4, 2, 3))}
    rows = [(n, *a.shape, a.astype(np.uint8).tobytes()) for n, a in px.items()] + [("cut.png", 4, 4, 3, b"123")]
    assert files.write_images(spark.createDataFrame(rows, "path string, height int, width int, nChannels int, data binary"), str(tmp_path)) == 3
    back = {r["path"].split("/")[-1]: np.frombuffer(bytes(r["data"]), np.uint8).reshape(r["height"], r["width"], -1) for r in images.read_images(spark, str(tmp_path)).collect()}
    assert set(back) == set(px)
    assert all((back[n] == a).all() for n, a in px.items())


def test_appending_a_run_again_adds_nothing(spark, tmp_path):
    path = f"{tmp_path}/manifest"
    make = lambda *pairs: spark.createDataFrame(list(pairs), "stem string, n int")
    tables.append_once(make(("a", 1), ("b", 2), ("b", 3)), path, "one")
    for _ in range(2):
        tables.append_once(make(("b", 9), ("c", 4)), path, "2")
    assert sorted(tuple(r) for r in tables.read_manifest(spark, path).select("run", "stem", "n").collect()) == [("2", "c", 4), ("one", "a", 1), ("one", "b", 2)]
    tables.append_once(make(("c", 5)), path, "2")
    assert tables.read_manifest(spark, path).where("stem = 'c'").first()["n"] == 5


def test_one_reading_tells_cells_and_broken_files(spark, tmp_path):
    from pixelwarrant.sources import files

    rows = [("1.png", 2, 2, 3, bytes(range(12))), ("2.png", 2, 2, 3, b"123"), ("3.png", 1, 2, 3, bytes(6))]
    files.write_images(spark.createDataFrame(rows, "path string, height int, width int, nChannels int, data binary").coalesce(1), str(tmp_path))
    number = F.regexp_extract("path", r"/(\d+)\.png$", 1).cast("long").alias("image_id")
    every = images.read_images(spark, str(tmp_path), invalid=True).select(number, "height", "width", "nChannels", "data").coalesce(1)
    got = [tuple(r) for r in images.image_cells(every).orderBy("image_id", "y", "x").select("image_id", "y", "x", "r").collect()]
    assert got == [(1, 0, 0, 2.0), (1, 0, 1, 5.0), (1, 1, 0, 8.0), (1, 1, 1, 11.0), (2, None, None, None), (3, 0, 0, 0.0), (3, 0, 1, 0.0)]
    assert images.read_images(spark, str(tmp_path)).count() == 2
