import math

import numpy as np
import pytest

from pixelwarrant.llm import ann_tree
from pixelwarrant.llm.queries import op9_nearest


def brute(vectors, queries, k):
    """{query: [(id, score)]} by comparing everything."""
    out = {}
    for q in queries:
        s = sorted(((-math.fsum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q))
        out[q] = [(i, -x) for x, i in s[:k]]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_query_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in rows}
    got, want = by_query(op9_nearest(spark, sf).collect()), brute(vectors, [i for i in vectors if i % 20 == 0], 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - math.fsum(a * b for a, b in zip(vectors[q], vectors[i]))) < 1e-12 for i, s in found)


def test_recall_of_a_deep_tree_with_a_hot_leaf(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 3, (40, 16))
    x = np.concatenate([centers[rng.integers(0, 40, 4000)] + rng.normal(0, 1, (4000, 16)), 5 + rng.normal(0, 1e-3, (2000, 16))])
    vectors = {i: v.tolist() for i, v in enumerate(x)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(5)
    got = by_query(ann_tree.nearest(df, df.where("vec_id % 50 = 0"), 10).collect())
    want = brute(vectors, [i for i in vectors if i % 50 == 0], 10)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_edges_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.5, 0.5]), (4, [0.5, 0.5]), (5, [0.0, 0.0]), (6, None), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = by_query(ann_tree.nearest(df, df.where("vec_id % 20 = 0"), 3).collect())
    assert got == {0: [(3, 1.0), (20, 1.0), (4, 0.5)], 20: [(0, 1.0), (3, 1.0), (4, 0.5)]}
    every = by_query(ann_tree.nearest(df, df.where("vec_id = 0"), 50).collect())
    assert every == {0: [(3, 1.0), (20, 1.0), (4, 0.5), (11, -1.0)]}
    assert ann_tree.nearest(df.limit(0), df).count() == 0 and ann_tree.nearest(df, df.limit(0)).count() == 0
    one = df.where("vec_id = 0")
    assert ann_tree.nearest(one, one).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(500)], "vec_id long, embedding array<double>")
    assert by_query(ann_tree.nearest(same, same.where("vec_id = 3"), 4).collect()) == {3: [(i, 5.0) for i in (0, 1, 2, 4)]}
    with pytest.raises(ValueError):
        ann_tree.nearest(df.union(spark.createDataFrame([(77, [1.0], "")], df.schema)), df)


def test_tasks_hand_on_k_rows_a_query(spark, monkeypatch):
    """What moves on grows with queries and tasks, not with the pairs of blocks; a task that holds too much hands on in parts."""
    rng = np.random.default_rng(4)
    vectors = {i: v.tolist() for i, v in enumerate(rng.normal(0, 1, (3000, 8)))}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    handed, ranked = [], ann_tree.ranked

    def counted(found, k):
        handed.append((found.count(), found.rdd.getNumPartitions()))
        return ranked(found, k)

    monkeypatch.setattr(ann_tree, "ranked", counted)
    queries = [i for i in vectors if i % 50 == 0]
    want = brute(vectors, queries, 5)
    for bytes_ in (ann_tree.HELD_BYTES, 5000):
        monkeypatch.setattr(ann_tree, "HELD_BYTES", bytes_)
        got = by_query(ann_tree.nearest(df, df.where("vec_id % 50 = 0"), 5).collect())
        assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    assert handed[0][0] <= len(queries) * 5 * handed[0][1]


def test_probes_are_not_broadcast(spark, tmp_path):
    """The leaves that a query visits multiply it in Python, where Spark doesn't see it: no side may be broadcast by its estimated size."""
    rng = np.random.default_rng(13)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((600, 4)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/v")
    df = spark.read.parquet(f"{tmp_path}/v")
    found = ann_tree.nearest(df, df.where("vec_id % 20 = 0"), k=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert len(found.collect()) == 90
