"""Mined collocations against a plain count of all phrases."""
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pixelwarrant.llm import collocations
from pixelwarrant.llm.queries import ORACLES, QUERIES


def brute(rows, least, cover, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, w[i : i + k]] += 1
    found = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = []
    for (lang, p), a in found.items():
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = [b for (x, q), b in found.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * b >= cover * a for b in inside):
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    rows = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        rows += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(rows)


def spoken(rng, letters, count):
    w = rng.choice(letters, count, p=np.arange(1, len(letters) + 1) / sum(range(1, len(letters) + 1)))
    gaps = rng.choice([" ", "  ", "\t", ", ", ". ", "\n", "!\r"], count, p=[0.7, 0.1, 0.05, 0.05, 0.05, 0.03, 0.02])
    return "".join(a + b for a, b in zip(w, gaps))


def test_random_texts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    letters = ["a", "B", "b", "é", "É", "cc", "d'", "to be", "of", "-"]
    rows = [(x, spoken(rng, letters, int(rng.integers(0, 80)))) for x in ["en", "de", None, "und", ""] * 12]
    rows += [("en", None), (None, None), ("fr", ""), ("fr", " . "), *rows[:5]]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("a", F.lit("x")).withColumn("code", F.lit(1))
    for least, cover, top in ((2, 80, 2000), (6, 50, 7), (3, 100, 2000)):
        got = sorted(tuple(r) for r in collocations.mine(df.repartition(3), least=least, cover=cover, top=top).collect())
        assert got == [r for r in brute(rows, least, cover, top)]
        assert got
    # A filter that lets all through changes nothing.
    monkeypatch.setattr(collocations.bloom, "build", lambda rows, names: np.full(1 << 14, np.iinfo(np.uint64).max, np.uint64))
    assert sorted(tuple(r) for r in collocations.mine(df, least=4).collect()) == brute(rows, 4, 80, 2000)


def test_shared_codes_are_noticed(spark, monkeypatch):
    real, laid, seeds = collocations.code, collocations.occurrences, []
    monkeypatch.setattr(collocations, "code", lambda lang, word, seed: b"\0" * 8 if seed == 0 and word in (b"x", b"y") else real(lang, word, seed))
    monkeypatch.setattr(collocations, "occurrences", lambda *args: seeds.append(args[-1]) or laid(*args))
    df = spark.createDataFrame([("en", "x y x y z"), ("en", "x y")], "lang string, text string")
    assert [tuple(r) for r in collocations.mine(df, least=2).collect()] == [("en", 1, "x y", 3, 3, 3, 7, 1_000_000)]
    assert seeds == [0, 1]


def test_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(empty).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None)], "lang string, text string")).collect() == []


def test_query_agrees_with_sql(spark, sf):
    got = sorted(tuple(r) for r in QUERIES["op12_collocations"](spark, sf).collect())
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(duckdb.sql(ORACLES["op12_collocations"]).fetchall()) and len(got) > 10
