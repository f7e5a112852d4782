"""Null keys, null and string orders, any n, sparse grids, and sessions without a shared folder."""
import pytest
from pyspark.sql import functions as F

from pixelwarrant.operators import calibration, ranks, training_log, windows
from pixelwarrant.session import durable
from pixelwarrant.sources import tables


def test_null_keys_keep_their_group(spark):
    rows = [(k, s / 10, int(s > y)) for k in ("a", None) for y, s in enumerate(range(12))] + [(None, 0.3, 0), ("a", 0.3, 0)]
    df = spark.createDataFrame(rows, "k string, score double, y int")
    assert {r.k for r in ranks.auc(df, ["k"], "score", "y").collect()} == {"a", None}
    points = ranks.roc_points(df, ["k"], "score", "y").collect()
    assert len([r for r in points if r.k is None]) == len([r for r in points if r.k == "a"]) == 12
    q = {(r.k, r.q): r.value for r in ranks.quantiles(df, ["k"], "score", [0.5]).collect()}
    assert q[None, 0.5] == q["a", 0.5]
    assert ranks.threshold_at_fpr(df, ["k"], "score", "y", 0.5).count() == 2


@pytest.mark.parametrize("kind", ["int", "double", "string", "date", "timestamp"])
def test_positions_in_any_order_type_with_nulls(spark, kind):
    values = [None, 3, 1, 2, None, 30, 12, 7]
    df = spark.createDataFrame([(None if i % 2 else "r", v, i) for i, v in enumerate(values)], "run string, v int, i int")
    order = {"date": F.date_add(F.lit("2020-01-01"), F.col("v")), "timestamp": F.timestamp_seconds(F.col("v") * 1000), "string": F.concat(F.lit("/data/p"), F.lpad("v", 3, "0"))}.get(kind, F.col("v").cast(kind))
    df = df.withColumn("v", order)
    got = ranks.positions(df, ["run"], ["v", "i"]).collect()
    assert len(got) == len(values)
    for run in ("r", None):
        own = sorted((r for r in got if r.run == run), key=lambda r: r.position)
        assert [r.position for r in own] == [1, 2, 3, 4]
        assert own == sorted(own, key=lambda r: (r.v is not None, r.v if r.v is not None else 0, r.i))


def test_first_n_is_the_same_path_for_any_n(spark):
    df = spark.range(1500).select(F.lit("c").alias("c"), F.concat(F.lit("p/"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("path"))
    for n in (5, 1000, 1001, 5000):
        got = ranks.first_n(df, ["c"], ["path"], n).collect()
        assert sorted(r.path for r in got) == [f"p/{i:06d}" for i in range(min(n, 1500))]


def test_epochs_before_the_first_metric_stay(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 0.5), ("a", 3, 0.4), (None, 1, 0.1)], "run string, epoch_no int, m double")
    got = {(r.run, r.epoch_no): (r.best, r.stale) for r in training_log.best_so_far(df, "run", ["epoch_no"], "m").collect()}
    assert got == {("a", 1): (None, 0), ("a", 2): (0.5, 0), ("a", 3): (0.5, 1), (None, 1): (0.1, 0)}


def test_boxes_over_missing_cells(spark):
    cells = spark.createDataFrame([(1, y, x, 1.0) for y in range(4) for x in range(8) if (y, x) not in {(3, 7), (1, 2), (0, 0)}], "image_id long, y int, x int, v double")
    boxes = spark.createDataFrame([(1, 0, 0, 8, 4), (1, 7, 3, 8, 4), (1, 1, 1, 3, 2), (1, 6, 2, 10, 6), (2, 0, 0, 2, 2)], "image_id long, x0 int, y0 int, x1 int, y1 int")
    got = {(r.image_id, r.x0, r.y0): r.s for r in windows.box_sums(boxes, cells, {"s": F.col("v")}).collect()}
    assert got == {(1, 0, 0): 29.0, (1, 7, 3): 0.0, (1, 1, 1): 1.0, (1, 6, 2): 3.0, (2, 0, 0): 0.0}
    gated = windows.gated_windows(boxes, cells, F.lit(False)).collect()
    assert {(r.image_id, r.x0, r.y0) for r in gated} == set(got)  # each touches a cell that no coarse window covered
    full = spark.createDataFrame([(1, y, x, 1.0) for y in range(4) for x in range(8)], cells.schema)
    assert windows.gated_windows(boxes.where("x1 <= 8 and image_id = 1"), full, F.lit(False)).count() == 0


def test_two_shared_calibrators_are_an_error(spark):
    scored = spark.createDataFrame([(64, 0.4)], "scale int, score double")
    rows = [(None, "platt", 1.0, 0.0, None, True), (None, "platt", 2.0, 0.0, None, True)]
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS|more than one row"):
        calibration.calibrated(scored, spark.createDataFrame(rows, calibration.SCHEMA)).collect()


def test_no_folder_is_made_up(spark, monkeypatch):
    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: (a[0] if a else None) if key == "spark.checkpoint.dir" else get(self, key, *a))
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.scratch_dir(spark, "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        durable(spark.range(1).toDF("id"))
