"""Runs by the operator against a plain search of all periods."""
from hashlib import sha256
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from pixelwarrant.llm import periodic
from pixelwarrant.llm.queries import QUERIES


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i - q] for i in range(q, len(w))))


def brute(w):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(24, 3 * q) and smallest_period(w[start:j]) == q:
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(key, text, plant=True):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    n = len(w)
    h = crc32(str(key).encode()) if key is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = sorted(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    best = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return key, len(found), *best, sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), sha256(kept.encode()).hexdigest()


def test_runs_of_random_words_with_repeats():
    rng = np.random.default_rng(3)
    texts = []
    for letters in (1, 2, 3, 8):
        for _ in range(60):
            w = list(rng.integers(0, letters, rng.integers(0, 120)))
            for _ in range(rng.integers(0, 3)):
                q = int(rng.integers(1, 40))
                unit = list(rng.integers(0, letters, q))
                at = int(rng.integers(0, len(w) + 1))
                w[at:at] = (unit * 6)[: int(rng.integers(q, 5 * q + 2))]
            texts.append(w)
    codes = np.array([x for w in texts for x in w], np.int64)
    counts = np.array([len(w) for w in texts])
    doc = np.repeat(np.arange(len(texts)), counts)
    found = periodic.runs(codes, doc, np.concatenate([[0], np.cumsum(counts)]))
    assert found == [brute(w) for w in texts]
    assert sum(map(len, found)) > 100


def test_long_periods_and_one_word_a_hundred_thousand_times():
    unit = list(range(3000))
    codes = np.array(unit * 3 + [0] * 100_000, np.int64)
    found = periodic.runs(codes, np.zeros(len(codes), np.int64), np.array([0, len(codes)]))[0]
    assert found == [(0, 9001, 3000), (9000, 100_000, 1)]


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "b " * 30), (5, "a " * 30), (5, "a " * 30), (6, "x\x0by\x0cz\r" * 9 + "é ü w"), (7, "a b " * 11 + "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("n_runs", F.lit(-1))
    got = sorted(periodic.find(df, plant=periodic.planted).drop("runs", "collapsed").collect(), key=lambda r: (r[0] or 0, r[1]))
    assert [tuple(r) for r in got] == sorted((expected(*r) for r in rows), key=lambda r: (r[0] or 0, r[1]))
    plain = periodic.find(df).where("doc_id = 5").first()
    assert plain.collapsed == "a" and [tuple(r) for r in plain.runs] == [(0, 30, 1)]
    assert periodic.find(df.limit(0)).collect() == []


def test_query(spark, sf):
    got = QUERIES["op13_periodic_runs"](spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = {k: t for k, t in texts if len(t or "") < 4000}
    rows = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(rows) == len(texts)
    for k, t in short.items():
        assert rows[k] == expected(k, t)
    assert any(r[1] for r in rows.values())
