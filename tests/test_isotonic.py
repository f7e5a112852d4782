"""The merged isotonic fit against pooling one list, and the fits per scale."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelwarrant.operators import calibration, isotonic, ranks


def plain(points):
    """(lo, hi, y, w) of every level of sorted (x, s, w)."""
    out = []
    for x, s, w in points:
        out.append([x, x, s, w])
        while len(out) > 1 and out[-2][2] / out[-2][3] >= out[-1][2] / out[-1][3]:
            lo, _, s0, w0 = out[-2]
            _, hi, s1, w1 = out.pop()
            out[-1] = [lo, hi, s0 + s1, w0 + w1]
    return [(lo, hi, s / w, w) for lo, hi, s, w in out]


def test_pooling_whole_runs_is_pooling_one_by_one():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 400):
        for kind in range(4):
            w = rng.integers(1, 5, n).astype(float)
            y = (np.arange(n) / n, -np.arange(n) / n, rng.random(n), rng.random(n) + np.arange(n) / n)[kind]
            s = np.floor(w * y * 8) if kind != 1 else w * y
            first = isotonic.pool(s.copy(), w.copy())
            points = list(zip(range(n), s, w))
            assert list(first) == [lo for lo, *_ in plain(points)]


@pytest.mark.parametrize("buckets", [1, 5, 40])
def test_levels_of_many_keys(spark, buckets, monkeypatch):
    monkeypatch.setattr(isotonic, "FAN", 3)
    rng = np.random.default_rng(buckets)
    rows, wanted = [], set()
    for key, n in (("a", 150), ("b", 1), (None, 90), ("rising", 60), ("falling", 60)):
        x = np.sort(rng.choice(1000, n, replace=False)) / 1000
        w = rng.integers(1, 9, n).astype(float)
        share = {"rising": np.arange(n) / n, "falling": 1 - np.arange(n) / n}.get(key, np.clip(x + rng.normal(0, 0.4, n), 0, 1))
        s = np.round(w * share)
        rows += [(key, float(a), float(b), float(c)) for a, b, c in zip(x, s, w)]
        wanted |= {(key, lo, hi, round(y, 9), c) for lo, hi, y, c in plain(list(zip(x, s, w)))}
    df = spark.createDataFrame(rows, "k string, x double, s double, w double").repartition(4)
    got = isotonic.levels(df, ["k"], "x", "s", "w", buckets)
    assert {(r["k"], r["lo"], r["hi"], round(r["y"], 9), r["w"]) for r in got.collect()} == wanted


def test_fits_per_scale_in_one_go(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        scale = (64, 128, 224)[i % 3]
        truth = rng.random()
        rows.append((i, scale, float(np.round(truth ** (3 if scale == 64 else 1), 3)), int(rng.random() < truth)))
    rows += [(5000 + i, 500, 0.5, 1) for i in range(10)] + [(6000 + i, 900, 0.1 + i / 1000, int(i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, scale int, score double, label int")
    for method in ("isotonic", "platt"):
        kept, report = calibration.fit_per_scale(df, F.col("id") * 7, method=method)
        by = {r["scale"]: r for r in report.collect()}
        assert set(by) == {64, 128, 224, 500, 900, None}
        assert by[64]["kept"] and by[64]["ece_after"] < by[64]["ece_before"] / 2 and by[64]["skipped"] is None
        assert by[900]["skipped"] == "too few rows" and by[500]["skipped"] == "too few rows" and by[500]["ece_before"] is None
        assert by[None]["n"] == len(rows)
        assert all(r["kind"] == method for r in kept.collect()) and kept.where("scale = 64").count() == 1
        for r in kept.collect():
            if method == "isotonic":
                x, y = [k["x"] for k in r["knots"]], [k["y"] for k in r["knots"]]
                assert len(x) <= 64 and x == sorted(x) and y == sorted(y)


def test_knots_lie_on_the_whole_fit(spark):
    rng = np.random.default_rng(3)
    score = rng.random(2000).round(4)
    rows = [(float(s), int(rng.random() < s)) for s in score]
    counts = ranks.score_counts(spark.createDataFrame(rows, "score double, label int"), [], "score", "label")
    levels = [(r["lo"], r["hi"], r["y"]) for r in calibration.isotonic_levels(counts).collect()]
    knots = calibration.isotonic_knots(counts).first()["knots"]
    spots = np.sort(score)[np.unique(np.linspace(0, 1999, 64).round().astype(int))]
    assert [k["x"] for k in knots] == sorted(set(spots.tolist()))
    assert all(any(lo <= k["x"] <= hi and k["y"] == y for lo, hi, y in levels) for k in knots)
