import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from pixelwarrant.llm import toxicity
from pixelwarrant.llm.queries import op8_toxicity


def plain_ratios(docs, word):
    """The word's log ratio from the formulas, with dictionaries. docs: (words, class)."""
    n = [Counter(), Counter()]
    for words, y in docs:
        seen = set()
        for w in words:
            spelled = f"^{w}$"
            seen |= {(w, spelled[max(0, i - toxicity.ORDER + 1) : i], spelled[i]) for i in range(1, len(spelled))}
        n[y].update(Counter((h, x) for _, h, x in seen))
    toxic = {h for h, _ in n[1]}
    n = [Counter({k: v for k, v in c.items() if k[0] in toxic}) for c in n]
    pairs = set(n[0]) | set(n[1])
    after = Counter(x for _, x in pairs)
    total, out, spelled = [Counter(), Counter()], 0.0, f"^{word}$"
    types, kinds = [Counter(), Counter()], Counter(h for h, _ in pairs)
    for k in (0, 1):
        for (h, _), v in n[k].items():
            total[k][h] += v
            types[k][h] += 1
    for i in range(1, len(spelled)):
        h, x = spelled[max(0, i - toxicity.ORDER + 1) : i], spelled[i]
        if h not in toxic:
            continue
        both = total[0][h] + total[1][h]
        base = after[x] / len(pairs) if (h, x) in pairs else 1e-6
        shared = (max(n[0][h, x] + n[1][h, x] - toxicity.SHARED_DISCOUNT, 0) + toxicity.SHARED_DISCOUNT * kinds[h] * base) / both
        p = [(max(n[k][h, x] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * types[k][h] * shared) / total[k][h] if total[k][h] else shared for k in (0, 1)]
        out += math.log(p[1] / p[0])
    return out


def test_ratios_follow_the_formulas(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 11))) for _ in range(60)]
    docs = [([rng.choice(vocabulary) for _ in range(20)] + ["nasty"] * (i % 3 == 0), int(i % 3 == 0)) for i in range(30)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, (w, _) in enumerate(docs)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(docs)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    words = [*vocabulary[:20], "nasty", "nastier", "zzz"]
    want = [plain_ratios(docs, w) for w in words]
    assert np.allclose(model.of_words(words), want, atol=1e-4) and np.allclose(model.scorer().of_words(words), want, atol=1e-4)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in op8_toxicity(spark, sf).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    out = [(labels[d], r.predicted) for d, r in got.items() if r.held_out and d in labels]
    assert sum(p for y, p in out if y) >= 0.9 * sum(y for y, _ in out)
    assert sum(p for y, p in out if not y) <= 0.06 * sum(1 - y for y, _ in out)


def test_edges(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, score="s", toxic=9) for i, t in [(1, None), (2, ""), (3, "vile vile"), (4, "nice day"), (None, "vile"), (3, "vile vile"), (5, "x" * 100_000), (6, "nice vile words"), (7, "nice words")]], "doc_id long, text string, score string, toxic int")
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 0), (6, 1), (7, 0), (None, 1), (2, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    by = {(r.doc_id, r.text): r.score for r in rows}
    assert len(rows) == 9 and by[1, None] == by[2, ""] and abs(by[5, "x" * 100_000] - by[2, ""]) < 0.05 and by[3, "vile vile"] > by[4, "nice day"]
    assert docs.columns == toxicity.remove(docs, labels).columns
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {toxicity.EMPTY}
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), labels).weights is None
    assert docs.select(toxicity.held_out(F.col("doc_id"), 4, 2).alias("h")).where("h is null").count() == 0


def test_contexts_beyond_those_held_count_too(spark, sf, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 50_000 + " vile"), (-2, "")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    run = lambda: sorted((r.doc_id, r.score) for r in toxicity.score(docs, toxicity.train(docs, labels), drop_text=True).collect())
    whole = run()
    monkeypatch.setattr(toxicity, "CAPACITY", 300)
    monkeypatch.setattr(toxicity, "FREQUENT", 50)
    assert toxicity.train(docs, labels).rest[0].count() > 300
    held = run()
    assert len(whole) == len(held) == docs.count() and len({s for _, s in whole}) > 20
    assert [d for d, _ in whole] == [d for d, _ in held] and np.allclose([s for _, s in whole], [s for _, s in held], atol=1e-5)
