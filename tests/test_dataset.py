"""Dataset rules: leakage, balance, refusals, epoch logs."""
import pytest
from pyspark.sql import functions as F

from pixelwarrant.operators import dataset as ds
from pixelwarrant.operators import features, ranks, severities, training_log


def test_copies_stay_on_one_side(spark):
    rows = ds.expand_copies(spark.range(500).withColumnRenamed("id", "sample"), "sample", 2)
    split = ds.split_by_group(rows, "group_id", 0.2)
    sides = split.groupBy("group_id").agg(F.countDistinct("is_val").alias("n"))
    assert sides.where("n > 1").isEmpty()
    assert split.where("is_val and not is_aug").count() == 100
    again = ds.split_by_group(rows.repartition(3), "group_id", 0.2)
    assert again.where("is_val").select("group_id").distinct().exceptAll(split.where("is_val").select("group_id").distinct()).isEmpty()


def test_fixed_severity_and_random_copies_exclude_each_other():
    ds.check_copy_plan(0, "jpeg_q30")
    with pytest.raises(ValueError):
        ds.check_copy_plan(2, "jpeg_q30")


def test_group_ids_are_offset_and_layouts_compared(spark):
    one = spark.createDataFrame([(0,), (4,)], "group_id long")
    out = ds.union_caches([one, one], [[("x", 2)], [("x", 2)]])
    assert sorted(r["group_id"] for r in out.collect()) == [0, 4, 5, 9]
    with pytest.raises(ValueError, match="layouts"):
        ds.union_caches([one, one], [[("x", 2)], [("x", 3)]])


def test_quality_gate_raises_when_strict(spark):
    roots = spark.createDataFrame([("a",), ("b",), ("c",)], "dataset string")
    samples = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "dataset string, label int")
    problems = ds.root_problems(roots, samples, roots.where("dataset <> 'c'"))
    assert {r["dataset"]: r["problem"] for r in problems.collect()} == {"a": None, "b": "one-sided", "c": "missing"}
    with pytest.raises(ValueError, match="one-sided"):
        ds.require_sound_roots(problems)
    assert ds.require_sound_roots(problems, strict=False) is problems


def test_large_caps_do_not_need_one_task_per_class(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") < 3000, "hot").otherwise("cold").alias("class"))
    got = ds.per_class_cap(rows, "class", ["id"], 1500)
    assert {r["class"]: r["count"] for r in got.groupBy("class").count().collect()} == {"hot": 1500, "cold": 1000}
    assert got.where("class = 'hot'").agg(F.max("id")).first()[0] == 1499


def test_top_up_counts_what_exists(spark):
    rows = spark.range(10)
    assert [r["id"] for r in ds.top_up(rows, rows.where("id < 3"), "id", 5).collect()] == [3, 4]
    assert ds.top_up(rows, rows, "id", 5).count() == 0


def test_unknown_severity_and_small_images(spark):
    table = severities.severity_table(spark)
    with pytest.raises(ValueError, match="no_such"):
        severities.require_known(spark.createDataFrame([("no_such",)], "severity string"), table)
    row = spark.range(1).select(*[c.alias(n) for n, c in severities.allowed_magnitudes(F.lit(32)).items()]).first()
    assert row["resize_scales"] == [0.5] and row["blur_sigmas"] == [0.5] and row["jpeg_qualities"] == [90.0, 70.0]
    assert "DISABLED" in spark.range(1).select(severities.describe_plan(F.lit(16))).first()[0]


def test_random_plans_are_reproducible_and_as_likely_as_stated(spark):
    rows = spark.range(4000).withColumn("copy", F.lit(1))
    draw = severities.hashed_uniform("id", "copy", seed=3)
    plan = severities.random_plan(rows, F.lit(224), draw).select("id", F.explode("plan").alias("s")).select("id", "s.op")
    share = {r["op"]: r["count"] / 4000 for r in plan.groupBy("op").count().collect()}
    for op, p in severities.PROBABILITIES.items():
        assert share[op] == pytest.approx(p, abs=0.04)
    again = severities.random_plan(rows.repartition(5), F.lit(224), draw).select("id", F.explode("plan").alias("s")).select("id", "s.op")
    assert plan.exceptAll(again).isEmpty()


def test_scaler_uses_training_rows_and_checks_width(spark):
    rows = spark.createDataFrame([([1.0, 10.0],), ([3.0, 10.0],)], "features array<float>")
    scaler = features.fit_scaler(rows)
    got = sorted(r["features"] for r in features.apply_scaler(rows, scaler).collect())
    assert got[0][0] == pytest.approx(-1.0) and got[0][1] == 0.0
    with pytest.raises(Exception, match="width"):
        features.apply_scaler(spark.createDataFrame([([1.0],)], "features array<float>"), scaler).collect()
    with pytest.raises(ValueError, match="unknown"):
        features.select_blocks(F.col("features"), [("x", 2)], ["y"])


def test_collapse_needs_a_streak_and_the_grace_period(spark):
    bad = [1, 1, 0, 1, 1, 1, 0]
    log = spark.createDataFrame([("r", i, float(b)) for i, b in enumerate(bad)], "run string, e int, b double")
    streaks = training_log.collapse_streaks(log, "run", ["e"], F.col("b") > 0).orderBy("e")
    assert [r["streak"] for r in streaks.collect()] == [1, 2, 0, 1, 2, 3, 0]
    alarm = training_log.collapse_alarms(log, "run", ["e"], F.col("b") > 0, patience=2, grace=2).first()
    assert alarm["alarm_epoch"] == 5
    best = training_log.stop_epochs(log, "run", ["e"], "b", patience=3).first()
    assert best["stop_epoch"] == 4


def test_running_totals_over_one_hot_key(spark):
    df = spark.range(3000).withColumn("k", F.lit("hot"))
    got = ranks.running(df, ["k"], ["id"], {"s": ("sum", F.col("id")), "m": ("max", -F.col("id"))})
    assert got.where((F.col("s") != F.col("id") * (F.col("id") + 1) / 2) | (F.col("m") != 0)).isEmpty()
