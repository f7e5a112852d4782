"""Trees grown many at once against one plain tree at a time."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelwarrant.operators import boosting


def plain(bins, y, train, columns, s):
    """The margins of all rows after every round, by recursion on row masks."""
    w = np.where(y == 1, (y[train] == 0).sum() / max((y[train] == 1).sum(), 1), 1.0)
    margin, out = np.zeros(len(y)), []
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        step = np.zeros(len(y))

        def grow(rows, depth):
            own = rows & train
            gt, ht = g[own].sum(), h[own].sum()
            best = None
            for f in columns:
                for b in range(bins[:, f].max() + 1):
                    left = own & (bins[:, f] <= b)
                    gl, hl = g[left].sum(), h[left].sum()
                    if depth < s.depth and hl >= s.least_weight and ht - hl >= s.least_weight:
                        gain = round(gl**2 / (hl + s.l2) + (gt - gl) ** 2 / (ht - hl + s.l2) - gt**2 / (ht + s.l2), 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, f, b)
            if best is None:
                step[rows] = -s.step * gt / (ht + s.l2)
                return
            low = bins[:, best[1]] <= best[2]
            grow(rows & low, depth + 1)
            grow(rows & ~low, depth + 1)

        grow(np.ones(len(y), bool), 0)
        margin = margin + step
        out.append(margin)
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(160, 4)).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.5, 160) > 0.3).astype(int)
    fold = np.arange(160) % 4
    rows = [(i, int(v), int(k), [float(a) for a in r]) for i, (v, k, r) in enumerate(zip(y, fold, x))]
    return x, y, fold, spark.createDataFrame(rows, "sample_id long, y int, fold int, features array<double>").repartition(3)


def test_folds_and_column_subsets_grow_as_if_alone(data):
    x, y, fold, rows = data
    s = boosting.Settings(rounds=3, depth=3, step=0.3, subsample=1.0, bins=8)
    models = {
        "all": boosting.Model(F.lit(True)),
        "fold1": boosting.Model(F.col("fold") != 1, F.col("fold") == 1),
        "two": boosting.Model(F.col("fold") > 0, None, [1, 3]),
    }
    fitted = boosting.fit(rows, models, s)
    bins = boosting.binned(x, fitted.cuts)
    masks = {"all": (fold >= 0, range(4)), "fold1": (fold != 1, range(4)), "two": (fold > 0, (1, 3))}
    got = {(r["model"], r["sample_id"]): r["pred"] for r in boosting.score(fitted, rows).collect()}
    for name, (train, columns) in masks.items():
        margins = plain(bins, y, train, columns, s)[fitted.best.get(name, 3) - 1]
        assert [got[name, i] for i in range(160)] == pytest.approx(list(1 / (1 + np.exp(-margins))), abs=1e-9)


def test_the_best_round_is_kept_and_growing_stops(data, spark, tmp_path):
    _, _, _, rows = data
    s = boosting.Settings(rounds=40, depth=3, step=0.5, check=1, patience=3)
    fitted = boosting.fit(rows, {"m": boosting.Model(F.col("fold") < 2, F.col("fold") == 2)}, s)
    aucs = [auc for _, _, auc in fitted.history]
    assert len(aucs) < 40 and fitted.best["m"] == 1 + int(np.argmax(aucs)) and len(aucs) == fitted.best["m"] + 3
    boosting.save(fitted, spark, str(tmp_path / "trees"))
    one = lambda e: sorted((r["sample_id"], r["pred"]) for r in boosting.score(e, rows).collect())
    assert one(fitted) == one(boosting.load(spark, str(tmp_path / "trees")))


def test_wrong_width_is_an_error(data, spark):
    _, _, _, rows = data
    fitted = boosting.fit(rows, {"m": boosting.Model(F.lit(True))}, boosting.Settings(rounds=1, depth=1))
    with pytest.raises(Exception, match="must hold 4 numbers"):
        boosting.score(fitted, rows.withColumn("features", F.slice("features", 1, 3))).collect()
