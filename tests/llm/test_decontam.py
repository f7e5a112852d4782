import random

import numpy as np
from pyspark.sql import Row

from pixelwarrant.llm import decontam
from pixelwarrant.llm.queries import op10_decontaminate


def nearest(item, text):
    """Least edit distance of `item` to any part of `text`, cell by cell."""
    a, b = np.array([ord(c) for c in item]), [ord(c) for c in text]
    row, best = np.arange(len(a) + 1), len(a)
    steps = np.arange(len(a) + 1)
    for c in b:
        new = np.minimum(row + 1, np.concatenate([[0], row[:-1] + (a != c)]))
        new[0] = 0
        row = np.minimum.accumulate(new - steps) + steps  # insertions
        best = min(best, row[-1])
    return int(best)


def test_search_is_the_edit_distance():
    rng = random.Random(3)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        distance, end = decontam.search(item, text)
        assert distance == nearest(item, text)
        assert distance == nearest(item, text[:end])


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("xyz")
        elif kind == 1:
            out.insert(at, rng.choice("xyz"))
        else:
            del out[at]
    return "".join(out)


def test_every_occurrence_within_the_budget_is_found():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    items = [(i, decontam.normal(" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))))) for i in range(30)]
    known = decontam.Items(items, 0.1, 20)
    for _ in range(60):
        item_id, item = rng.choice(items)
        text = " ".join([*(rng.choice(words) for _ in range(30)), edited(rng, item, rng.randint(0, len(item) // 7)), *(rng.choice(words) for _ in range(30))])
        text = decontam.normal(text)
        got = {x["item_id"]: x for x in known.leaks(text)}
        want = {i for i, t in items if nearest(t, text) <= int(len(t) * 0.1)}
        assert set(got) == want
        for i, x in got.items():
            own = dict(items)[i]
            assert nearest(own, text[x["start"] : x["end"]]) <= x["distance"] <= len(own) * 0.1


def test_edges(spark):
    long_item = "the quick brown fox jumps over the lazy dog again and again"
    benchmark = spark.createDataFrame([Row(item_id=1, text=long_item), Row(item_id=2, text="Yes!"), Row(item_id=3, text=None), Row(item_id=4, text=" .,"), Row(item_id=1, text=long_item)], "item_id long, text string")
    texts = [None, "", "well yes it is", "YES", f"intro: The quick-brown fox  jumps over a lazy dog, again AND again. end", "word " * 50_000 + long_item, long_item[:40]]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, item_id="x", leaks=1) for i, t in enumerate([*texts, texts[4]])], "doc_id long, text string, item_id string, leaks int")
    rows = {r.doc_id: r.leaks for r in decontam.scan(docs, benchmark).collect()}
    assert {k: {x.item_id for x in v} for k, v in rows.items()} == {0: set(), 1: set(), 2: set(), 3: {2}, 4: {1}, 5: {1}, 6: set(), 7: {1}}
    assert rows[5][0].distance == 0 and rows[5][0].start == 250_000
    assert sorted(r.doc_id for r in decontam.remove(docs, benchmark).collect()) == [0, 1, 2, 6]
    assert decontam.scan(docs.limit(0), benchmark).count() == 0
    assert decontam.remove(docs, benchmark.limit(0)).count() == docs.count()
    assert [len(b) for b in decontam.blocks(benchmark, "item_id", "text", most=62)] == [2, 1]


def test_query_against_all_pairs(spark, sf):
    items = [(r.item_id, decontam.normal(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op10_decontaminate(spark, sf).collect()}
    docs = [(r.doc_id, decontam.normal(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    exact = {(d, i) for d, text in docs for i, item in items if item in text}
    assert exact and exact <= got
    short = [(d, text) for d, text in docs if len(text) < 900][:25] + [(d, text) for d, text in docs if len(text) < 2000 and any(d == x for x, _ in got)][:5]
    for d, text in short:
        assert {i for i, item in items if nearest(item, text) <= int(len(item) * 0.1)} == {i for x, i in got if x == d}


def test_short_items_match_unchanged_between_word_edges(spark):
    items = spark.createDataFrame([(1, "What is 2 plus 2?"), (2, "\u6771\u4eac\u306e\u4eba\u53e3\u306f\u3044\u304f\u3064\u304b"), (3, "ten")], "item_id long, text string")
    docs = [(1, "so, what is 2 plus 2 then"), (2, "what is 2 plus 22"), (3, "x \u6771\u4eac\u306e\u4eba\u53e3\u306f\u3044\u304f\u3064\u304b?"), (4, "often tenth"), (5, "ten"), (6, "what is 2 minus 2")]
    found = decontam.scan(spark.createDataFrame(docs, "doc_id long, text string"), items)
    got = {r.doc_id: [(x.item_id, x.distance) for x in r.leaks] for r in found.collect()}
    assert got == {1: [(1, 0)], 2: [], 3: [(2, 0)], 4: [], 5: [(3, 0)], 6: []}
