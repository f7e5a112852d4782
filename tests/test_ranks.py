"""Rank metrics against brute force, ties and absent classes included."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelwarrant.operators import bootstrap, calibration, metrics, ranks


def pair_auc(pos, neg):
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def frame(spark, pos, neg, key="a"):
    rows = [(key, float(s), 1) for s in pos] + [(key, float(s), 0) for s in neg]
    return spark.createDataFrame(rows, "k string, score double, y int")


@pytest.mark.parametrize("digits", [1, 2, 8])
def test_auc_equals_pair_count(spark, digits):
    rng = np.random.default_rng(digits)
    pos, neg = rng.beta(3, 2, 700).round(digits), rng.beta(2, 3, 500).round(digits)
    got = ranks.auc(frame(spark, pos, neg), ["k"], "score", "y").first()["auc"]
    assert got == pytest.approx(pair_auc(pos, neg), abs=1e-9)


def test_auc_edge_cases(spark):
    df = frame(spark, [1.0] * 20, [1.0] * 20, "ties").union(frame(spark, [0.9], [], "alone")).union(frame(spark, [0.1], [0.9], "wrong"))
    got = {r["k"]: r["auc"] for r in ranks.auc(df, ["k"], "score", "y").collect()}
    assert got == {"ties": 0.5, "alone": None, "wrong": 0.0}


def test_one_score_holding_a_third_of_the_rows(spark):
    rng = np.random.default_rng(5)
    pos = np.concatenate([rng.random(400), np.full(250, 0.5)])
    neg = np.concatenate([rng.random(400), np.full(150, 0.5)])
    df = frame(spark, pos, neg)
    assert ranks.auc(df, ["k"], "score", "y").first()["auc"] == pytest.approx(pair_auc(pos, neg), abs=1e-9)
    q = {r["q"]: r["value"] for r in ranks.quantiles(df, ["k"], "score", [0.0, 0.3, 0.5, 0.9, 1.0]).collect()}
    for p, v in q.items():
        assert v == pytest.approx(np.quantile(np.concatenate([pos, neg]), p), abs=1e-12)


def test_positions_are_a_total_order(spark):
    df = spark.range(5000).withColumn("v", (F.col("id") * 7919) % 1000)
    got = ranks.positions(df, [], ["v", "id"]).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 5001))
    assert [(r["v"], r["id"]) for r in got] == sorted((r["v"], r["id"]) for r in got)


def test_threshold_keeps_the_budget(spark):
    df = frame(spark, [0.9, 0.8, 0.8, 0.3], [0.85] + [0.1] * 19)
    got = ranks.threshold_at_fpr(df, ["k"], "score", "y", 0.05).first()
    assert (got["threshold"], got["tpr"], got["fpr"]) == (0.3, 1.0, 0.05)
    none = ranks.threshold_at_fpr(frame(spark, [0.1], [0.9]), ["k"], "score", "y", 0.5).first()
    assert none["threshold"] is None and none["tpr"] == 0.0


def test_matched_recall_matches_numpy(spark):
    rng = np.random.default_rng(3)
    pos, neg = rng.beta(3, 2, 200), rng.beta(2, 3, 150)
    got = metrics.matched_recall(frame(spark, pos, neg), ["k"], "score", "y", 0.8).first()
    cut = np.quantile(pos, 0.2)
    assert got["threshold"] == pytest.approx(cut, abs=1e-12)
    assert got["false_positive_rate"] == pytest.approx((neg >= cut).mean(), abs=1e-12)


def paired(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    good = np.clip(0.35 + 0.3 * y + rng.normal(0, 0.2, n), 0, 1).round(3)
    poor = np.clip(0.5 + rng.normal(0, 0.2, n), 0, 1).round(3)
    return y, good, poor, spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, good, poor)], "y int, p double, q double")


def test_bootstrap_interval_is_close_to_resampling(spark):
    y, good, poor, df = paired(spark)
    got = bootstrap.paired_auc_delta(df, "p", "q", "y", replicates=600).first()
    rng = np.random.default_rng(1)
    deltas = []
    for _ in range(600):
        i, j = rng.choice(np.flatnonzero(y == 1), 60), rng.choice(np.flatnonzero(y == 0), 60)
        deltas.append(pair_auc(good[i], good[j]) - pair_auc(poor[i], poor[j]))
    low, high = np.percentile(deltas, [2.5, 97.5])
    assert got["delta"] == pytest.approx(pair_auc(good[y == 1], good[y == 0]) - pair_auc(poor[y == 1], poor[y == 0]), abs=1e-9)
    assert got["ci_low"] == pytest.approx(low, abs=0.06) and got["ci_high"] == pytest.approx(high, abs=0.06)
    assert got["significant"]


def test_bootstrap_does_not_depend_on_partitioning(spark):
    """Ties that fall into different range partitions must be joined exactly."""
    _, _, _, df = paired(spark, seed=4)
    tied = df.select("y", F.round("p", 1).alias("p"), "q")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for parts in ("1", "7", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            rows = bootstrap.replicate_aucs(tied, "p", "q", "y", 25).orderBy("replicate").collect()
            seen.append([(r["replicate"], round(r["auc_with"], 9), round(r["auc_without"], 9)) for r in rows])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert seen[0] == seen[1] == seen[2]


def scored(spark, n=1500, seed=0):
    rng = np.random.default_rng(seed)
    truth = rng.random(n)
    y = (rng.random(n) < truth).astype(int)
    raw = np.clip(truth**3, 0.0, 1.0)
    return spark.createDataFrame([(i, float(s), int(v)) for i, (s, v) in enumerate(zip(raw, y))], "id long, score double, label int")


def test_platt_recovers_the_slope(spark):
    a, b = calibration.fit_platt(scored(spark))
    assert 0.2 < a < 0.6 and np.isfinite(b)


def test_platt_refuses(spark):
    flipped = scored(spark).withColumn("label", 1 - F.col("label"))
    with pytest.raises(ValueError, match="slope"):
        calibration.fit_platt(flipped)
    with pytest.raises(ValueError, match="both classes"):
        calibration.fit_platt(scored(spark).where("label = 1"))


def test_isotonic_is_monotone_thinned_and_helps(spark):
    df = scored(spark)
    knots = calibration.fit_isotonic(df).first()["knots"]
    xs, ys = [k["x"] for k in knots], [k["y"] for k in knots]
    assert len(knots) <= 64 and xs == sorted(xs) and ys == sorted(ys)
    cal = spark.createDataFrame([(None, "isotonic", None, None, [(k["x"], k["y"]) for k in knots], True)], calibration.SCHEMA)
    applied = calibration.calibrated(df.withColumn("scale", F.lit(64)), cal)
    before = calibration.calibration_error(df, [], "score", "label").first()["ece"]
    after = calibration.calibration_error(applied, [], "score", "label").first()["ece"]
    assert after < before / 2


def test_bin_edges_follow_the_edge_array(spark):
    got = spark.range(1).select(*[calibration.ece_bin(F.lit(p)).alias(str(i)) for i, p in enumerate((0.0, 0.1, 0.3, 0.95, 1.0))]).first()
    assert list(got) == [0, 1, int(np.digitize(0.3, np.linspace(0, 1, 11)[1:-1])), 9, 9]
