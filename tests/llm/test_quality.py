import zlib

import numpy as np
from pyspark.sql import Row

from pixelwarrant.llm import quality
from pixelwarrant.llm.queries import op6_quality


def test_pairs_reach_the_optimum():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.5, 1, (80, 3)), rng.normal(0, 1, (30, 3))
    w = quality.fit_pairs(good, bad, np.random.default_rng(2))
    again = np.random.default_rng(2)
    n = quality.PAIRS * 30
    d = good[quality._dealt(80, n, again)] - bad[quality._dealt(30, n, again)]
    assert np.abs((d / (1 + np.exp(d @ w))[:, None]).mean(0) - quality.RIDGE * w).max() < 1e-8


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in op6_quality(spark, sf).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    out = [(labels[d], r.predicted) for d, r in got.items() if r.held_out and d in labels]
    assert sum(y == p for y, p in out) >= 0.97 * len(out)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "A good text, with words. And more of them."), (4, "x!! y!! X!! Y!!"), (None, "a"), (3, "A good text, with words. And more of them."), (5, "z" * 3_000_000)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, score="s", quality=9) for i, t in rows], "doc_id long, text string, score string, quality int")
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (2, None), (99, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    by = [(r.doc_id, r.score) for r in quality.score(docs, model).collect()]
    assert len(by) == 7 and len({s for i, s in by if i in (1, 2)}) == 1 and max(s for i, s in by if i == 3) > max(s for i, s in by if i == 4)
    assert quality.train(docs, labels.limit(0)) is None and quality.train(docs.limit(0), labels) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0
