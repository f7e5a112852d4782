import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from pixelwarrant.llm import simhash
from pixelwarrant.llm.components import components
from pixelwarrant.llm.queries import op3_simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(fps, bits):
    """Root of every index, all pairs compared."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def check(rows, texts, bits=3):
    ids = sorted(texts)
    fps = [plain(texts[i]) for i in ids]
    roots = grouped(fps, bits)
    least = {}
    for i, r in zip(ids, roots):
        least.setdefault(r, i)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{f:016x}", least[r]) for i, f, r in zip(ids, fps, roots)}
    assert len(rows) == len(ids)


def test_query_against_all_pairs(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(op3_simhash(spark, sf).collect(), texts)


def test_edges_and_ties(spark):
    texts = {1: None, 2: "", 3: " \t", 4: "One", 5: "one", 6: "a b c d", 7: "A B  c\nd", 8: "É é", 9: "x " * 30_000}
    df = spark.createDataFrame([Row(doc_id=k, text=v, fp="taken", source=None) for k, v in texts.items()], "doc_id long, text string, fp string, source string")
    check(simhash.near_duplicates(df).collect(), texts)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    twice = simhash.near_duplicates(df.union(df)).collect()
    assert len(twice) == 2 * len(texts) and {r.component_id for r in twice if r.doc_id in (1, 2, 3)} == {1}
    kept = simhash.keep_one(df).collect()
    assert {1, 4, 6} <= {r.doc_id for r in kept} and not {2, 3, 5, 7} & {r.doc_id for r in kept}
    none = spark.createDataFrame([(None, "a b c"), (None, None)], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 2 and simhash.keep_one(none).count() == 2


@pytest.mark.parametrize("bits,parts", [(3, None), (3, 2), (3, 3), (0, None), (5, 4), (7, None)])
def test_links_are_all_found(spark, bits, parts):
    rng = random.Random(bits)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for k in range(9):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), k)))
    fps |= {rng.getrandbits(16) for _ in range(150)}  # many share three quarters of their bits
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits, parts).collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
    assert got == want


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 200 + i) for i in range(50)] + [(300, 301), (301, 302), (302, 300), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in [100, *range(200, 250)]} | {i: 300 for i in (300, 301, 302)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
