"""Words of recurring windows against a plain count of all windows."""
from collections import Counter
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from pixelwarrant.llm import substring_dedup
from pixelwarrant.llm.queries import QUERIES


def brute(rows, window):
    split = [(k, (t or "").encode().split()) for k, t in rows]
    often = Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = []
    for k, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if often[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def result(df):
    return sorted((tuple(r) for r in df.drop("spans").collect()), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_random_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD", 300)
    monkeypatch.setattr(substring_dedup, "LONG", 9)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "\U0001f600", "a\x00b", " "]
    make = lambda n: list(rng.choice(vocabulary, n))
    shared = [make(int(n)) for n in rng.integers(8, 90, 12)]
    rows = []
    for i in range(120):
        w = make(int(rng.integers(0, 60)))
        for _ in range(int(rng.integers(0, 3))):
            p = shared[int(rng.integers(0, len(shared)))]
            a = int(rng.integers(0, len(p) // 2))
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = p[a : int(rng.integers(a + 1, len(p) + 1))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += rows[:4] + [(500, " ".join(["x"] * 200)), (501, " ".join(["x", "y"] * 40)), (502, " ".join(make(11) * 9)), (None, rows[7][1]), (None, None), (503, ""), (504, " \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t1", F.lit("clash")).withColumn("plain", F.lit(1)).repartition(5)
    for window in (12, 35):
        got = substring_dedup.find(df, window=window)
        assert result(got) == brute(rows, window)
        assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got.collect())
    assert sum(r[2] for r in brute(rows, 35)) > 500


def test_split_passages_and_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "TASK_BYTES", 300)
    rng = np.random.default_rng(6)
    base = [f"v{i}" for i in rng.integers(0, 500, 120)]
    rows = []
    for i in range(40):
        w = list(base)
        w[int(rng.integers(0, 120))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    assert result(substring_dedup.find(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 35)


def test_occurrences_of_parts_of_passages():
    for window in (3, 4, 5, 12):
        rng = np.random.default_rng(window)
        for letters in (1, 2, 5, 40):
            passages = [[f"{x}" for x in rng.integers(0, letters, int(n))] for n in rng.integers(window, 3 * window, 4)]
            text = []
            for _ in range(8):
                p = passages[int(rng.integers(0, 4))]
                a = int(rng.integers(0, len(p)))
                text += p[a : int(rng.integers(a, len(p) + 1))] + [f"{x}" for x in rng.integers(0, letters, 2)]
            known = {tuple(p[i : i + window]) for p in passages for i in range(len(p) - window + 1)}
            covered = set()
            for i in range(len(text) - window + 1):
                if tuple(text[i : i + window]) in known:
                    covered.update(range(i, i + window))
            made = substring_dedup.Passages([" ".join(p).encode() for p in passages], window)
            starts, ends = made.spans(" ".join(text).encode())
            assert {i for a, b in zip(starts, ends) for i in range(a, b)} == covered


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.find(empty).collect() == []
    few = spark.createDataFrame([(1, None), (1, None)], "doc_id long, text string")
    assert result(substring_dedup.find(few)) == brute([(1, None), (1, None)], 35)


def test_query(spark, sf):
    got = QUERIES["op11_substring_dedup"](spark, sf)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(got) == brute(rows, 35)
