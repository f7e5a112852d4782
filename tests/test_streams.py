"""Streams whose rows come in many micro-batches, late and shuffled, against the numbers of all rows so far."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelwarrant.streaming import jobs


def replay(spark, tmp_path, batches, schema):
    """One file per micro-batch, in order of writing."""
    import os
    import time

    folder = str(tmp_path / "rows")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/made/{i}")
        part = next((tmp_path / "made" / str(i)).glob("*.parquet"))
        os.makedirs(folder, exist_ok=True)
        target = f"{folder}/{i:03d}.parquet"
        os.link(part, target)
        os.utime(target, (time.time() - 1000 + i, time.time() - 1000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def pair_auc(pos, neg):
    pos, neg = np.array(pos, float), np.array(neg, float)
    if not len(pos) or not len(neg):
        return None
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


@pytest.mark.parametrize("segments", [1, 7, 1024])
def test_running_numbers_are_exact_after_every_batch(spark, tmp_path, segments):
    rng = np.random.default_rng(segments)
    classes = ["real", "synthetic", "tampered"]
    batches = []
    for size in (1, 40, 3, 60, 25):
        scores = np.where(rng.random(size) < 0.5, rng.random(size).round(1), rng.normal(0.5, 0.6, size))
        batches.append([(classes[rng.integers(0, 3)], float(s), int(rng.integers(0, 3))) for s in scores])
    batches[2] += [(None, 0.5, 1), ("real", None, 1), ("real", 0.3, None)]
    seen = {}
    stream = replay(spark, tmp_path, batches, "class string, score double, n_regions int")
    jobs.running_evaluation(stream, lambda numbers, i: seen.update({i: numbers.first()}), str(tmp_path / "state"), segments).awaitTermination()
    assert sorted(seen) == list(range(5))
    so_far = []
    for i, batch in enumerate(batches):
        so_far += [r for r in batch if r[0] is not None and r[1] is not None]
        real = [r for r in so_far if r[0] == "real"]
        expected = [pair_auc([r[1] for r in so_far if r[0] in kinds], [r[1] for r in real]) for kinds in (("synthetic", "tampered"), ("tampered",))]
        rate = sum((r[2] or 0) > 0 for r in real) / len(real) if real else None
        got = seen[i]
        assert got["n"] == len(so_far)
        for value, wanted in zip((got["auc"], got["auc_tampered"], got["fp_rate"]), (*expected, rate)):
            assert value == wanted if wanted is None else value == pytest.approx(wanted, abs=1e-12)


def batch_alarms(rows, patience, grace):
    out, latest = {}, {}
    for run, epoch, std, auc in rows:
        latest[run, epoch] = std < 0.2 and auc < 0.55
    for run in {r[0] for r in rows}:
        streak = 0
        for epoch in sorted(e for r, e in latest if r == run):
            streak = streak + 1 if latest[run, epoch] else 0
            if streak >= patience and epoch >= grace:
                out[run] = epoch
                break
    return out


@pytest.mark.parametrize("block", [1, 3, 64])
def test_alarms_do_not_depend_on_the_order_of_arrival(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    rows = [(f"run{r}", int(e), float(rng.choice([0.1, 0.3], p=[0.7, 0.3])), float(rng.choice([0.5, 0.6], p=[0.8, 0.2]))) for r in range(9) for e in rng.choice(60, 25, replace=False)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    batches = [rows[:3], rows[3:90], rows[90:91], rows[91:]]
    seen = {}
    stream = replay(spark, tmp_path, batches, "run string, epoch long, val_pred_std double, val_auc double")
    show = lambda alarms, i: seen.update({i: {r["run"]: r["alarm_epoch"] for r in alarms.collect()}})
    jobs.collapse_alarms(stream, show, str(tmp_path / "state"), patience=3, grace=5, std_below=0.2, block=block).awaitTermination()
    so_far = []
    for i, batch in enumerate(batches):
        so_far += batch
        assert seen[i] == batch_alarms(so_far, 3, 5)
    assert seen[3]


@pytest.mark.parametrize("shards", [1, 2])
def test_runs_of_a_shard_keep_their_own_epochs(spark, tmp_path, shards):
    """Runs that share a block's state arrive in different batches, and an epoch comes again."""
    rows = [("a", 5, 0.1, 0.5), ("b", 6, 0.1, 0.5), ("b", 5, 0.3, 0.5), ("a", 6, 0.1, 0.5), ("a", 4, 0.3, 0.6), ("b", 7, 0.1, 0.5), ("a", 6, 0.3, 0.5), ("c", 9, 0.1, 0.5)]
    seen = {}
    stream = replay(spark, tmp_path, [rows[:2], rows[2:6], rows[6:]], "run string, epoch long, val_pred_std double, val_auc double")
    show = lambda alarms, i: seen.update({i: {r["run"]: r["alarm_epoch"] for r in alarms.collect()}})
    jobs.collapse_alarms(stream, show, str(tmp_path / "state"), patience=2, grace=2, std_below=0.2, shards=shards).awaitTermination()
    assert seen == {0: {}, 1: {"a": 6, "b": 7}, 2: {"b": 7}}


@pytest.mark.parametrize("name", ["str01_score_on_arrival", "str02_running_evaluation", "str03_collapse_alarm"])
def test_replayed_tables_may_be_folders(spark, sf, tmp_path, name):
    """A large table is a folder of part files; the replay read none of them."""
    from pixelwarrant.plans.catalog import QUERIES

    for table in ("embeddings", "lineitem", "events"):
        spark.read.parquet(f"{sf}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    rows = lambda at: sorted(map(tuple, QUERIES[name](spark, at).collect()))
    assert rows(str(tmp_path)) == rows(sf) != []
