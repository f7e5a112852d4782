"""Benchmark decontamination: approximate occurrences of test items in documents, by pieces and bit-parallel edit distance.

An item of m characters may differ from a passage by k = floor(m * rate) edits (insertions, deletions, substitutions). Cut into
k + 1 pieces, at least one piece occurs unchanged in every such passage, so the exact hits of all pieces (one automaton, one
pass over the text) hold every occurrence; each place they point to is verified with Myers' bit-parallel search. The pieces are
the leaves of a tree that halves item and budget (the halves of a budget k share k - 1: one of them keeps within its own), and
a hit is verified from its leaf upwards: a chance hit fails on a few dozen characters, a true one reaches the root.
Item and text are compared as their words (letters, digits and underscores), lower case, joined by single spaces.

The items are the stated set: they are read in blocks of at most `BLOCK_CHARS` characters, one pass over the documents for each
block, so what a task holds is bounded however many items there are. Documents are never shuffled.

Defined cases: a null or empty item matches nothing; an item shorter than `min_chars` has no budget and matches where a text holds it
unchanged between word edges, or, being one word of less than `WORD_CHARS`, only a text that is it; a null text has no leaks; repeated rows are scanned each; an empty table on either side gives no leaks; other
columns pass through, and one named like the output is replaced.
"""
from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_CHARS = 4_000_000
WORD_CHARS = 8
WORD = re.compile(r"\w+")
LEAKS = T.ArrayType(
    T.StructType(
        [T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
)


def normal(text: str | None) -> str:
    return " ".join(WORD.findall((text or "").lower()))


def search(item: str, text: str) -> tuple[int, int]:
    """(distance, end) of the part of `text` nearest to `item`, the first of several; Myers' recurrence on whole integers."""
    m = len(item)
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        places[c] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = places.get(c, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        more = down | (full & ~(across | up))
        less = up & across
        if more & high:
            score += 1
        elif less & high:
            score -= 1
        more <<= 1
        less <<= 1
        up = (less | ~(vertical | more)) & full
        down = more & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def halves(a: int, b: int, k: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """The k + 1 leaves (from, to) of the span a..b, each with the spans and budgets above it, the nearest first."""
    if k == 0:
        yield a, b, []
        return
    left = (k - 1) // 2
    cut = a + (b - a) * (left + 1) // (k + 1)
    for low, high, budget in ((a, cut, left), (cut, b, k - 1 - left)):
        for x, y, above in halves(low, high, budget):
            yield x, y, [*above, (a, b, k)]


class Items:
    """A block of items with the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int):
        import ahocorasick

        self.long: list[tuple[int, str, int]] = []
        self.short: set[int] = set()  # of `long`
        pieces: dict[str, list[tuple[int, int, list]]] = defaultdict(list)
        for item_id, text in items:
            m = len(text)
            k = int(m * rate)
            if m < min_chars:
                self.short.add(len(self.long))
                k = 0
            for a, b, above in halves(0, m, k):
                pieces[text[a:b]].append((len(self.long), a, above))
            self.long.append((item_id, text, k))
        self.automaton = ahocorasick.Automaton()
        for piece, own in pieces.items():
            self.automaton.add_word(piece, (len(piece), own))
        if pieces:
            self.automaton.make_automaton()

    def leaks(self, text: str) -> list[dict]:
        """The best occurrence of every item of this block that the normal form `text` holds, by item."""
        out = []
        if not self.long or not text:
            return out
        best: dict[int, tuple[int, int]] = {}
        seen: dict[int, int] = {}  # the last place that was verified for an item
        for last, (size, own) in self.automaton.iter(text):
            for item, offset, above in own:
                item_id, pattern, k = self.long[item]
                place = last + 1 - size - offset
                if item in seen and abs(place - seen[item]) <= k:
                    continue
                if item in self.short:
                    edges = ("",) if " " not in pattern and len(pattern) < WORD_CHARS else ("", " ")
                    if text[max(0, place - 1) : place] not in edges or text[last + 1 : last + 2] not in edges:
                        continue
                for a, b, budget in above:
                    start = max(0, place + a - budget)
                    distance, end = search(pattern[a:b], text[start : max(0, place + b + budget)])
                    if distance > budget:
                        break
                else:
                    if not above:
                        distance, start, end = 0, place, len(pattern)
                    seen[item] = place
                    if item not in best or distance < best[item][0]:
                        best[item] = distance, start + end
        for item, (distance, end) in sorted(best.items()):
            item_id, pattern, k = self.long[item]
            from_end = search(pattern[::-1], text[max(0, end - len(pattern) - k) : end][::-1])[1]
            out.append({"item_id": item_id, "distance": distance, "start": end - from_end, "end": end})
        return out


def blocks(benchmark: DataFrame, item: str, text: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in normal form, streamed to the driver in blocks of at most `most` characters (one item at least)."""
    own, chars = [], 0
    for row in benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).toLocalIterator():
        form = normal(row.t)
        if not form:
            continue
        if own and chars + len(form) > most:
            yield own
            own, chars = [], 0
        own.append((row.i, form))
        chars += len(form)
    if own:
        yield own


def scan(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    rate: float = 0.1, min_chars: int = 20, out: str = "leaks",
) -> DataFrame:
    """Add `leaks`: for every item that the text holds, its id, the edit distance, and the span in the text's normal form."""
    done = docs.drop(out).withColumn(out, F.array().cast(LEAKS))
    for own in blocks(benchmark, item, item_text):
        done = _pass(done, own, text, rate, min_chars, out)
    return done


def _pass(docs: DataFrame, items: list[tuple[int, str]], text: str, rate: float, min_chars: int, out: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items(shared.value, rate, min_chars)
        for batch in batches:
            found = [had.as_py() + known.leaks(normal(x.as_py())) for x, had in zip(batch.column(text), batch.column(out))]
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != out}
            yield pa.RecordBatch.from_pydict(columns | {out: pa.array(found, kind)})

    return docs.mapInArrow(run, docs.schema)


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = 0.1) -> DataFrame:
    """The documents that hold no item of the benchmark."""
    return scan(docs, benchmark, text, rate=rate, out="_leaks").where(F.size("_leaks") == 0).drop("_leaks")
