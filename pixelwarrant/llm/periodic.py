"""Periodic runs: stretches of words that repeat with a smallest period, and texts with the repetitions collapsed.

Online sparse diagonal DP: word after word, its earlier occurrences lengthen the matches of their lags, and a lag that is not lengthened
ends; a diagonal long enough gives a run at once. The earlier occurrences are thinned without loss. A run of period q and length
max(24, 3q) or more matches itself at lag q for max(24 - q, 2q) words or more, so a whole gram of L words does, where L is 16 or the
least power of two not below q. Inside a run of smallest period q, the nearest earlier occurrence of a gram of q words or more is
exactly q words away, as a primitive word is not found inside its square but at its ends. So each word has one lag for each L at most, that of
the gram which ends there, and only lags in (L/2, L] (up to 16 for the first) count there. Grams are named exactly, by pairs of names of
half their length, and only grams that a text holds twice are carried on: about n log n steps however often a word occurs.

A text is worked on in one task, whole; texts are independent, so nothing is shuffled. Defined cases: a null or wordless text has no
runs; a null key is planted nothing; repeated rows give repeated results; an empty table gives an empty one; columns of the input other
than the key and the text are not returned, so none can clash.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pixelwarrant.llm.words import chunks, words

LEAST = 24  # words of a run at least,
TIMES = 3  # and periods
GRAM = 16

Run = tuple[int, int, int]


def nearest(names: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For entries sorted by place: the distance to the last earlier entry of the same name, 0 for none."""
    order = np.argsort(names, kind="stable")
    same = names[order][1:] == names[order][:-1]
    out = np.zeros(len(names), np.int64)
    out[order[1:][same]] = (at[order[1:]] - at[order[:-1]])[same]
    return out


def repeated(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense names and places of what is named twice or more."""
    _, dense, counts = np.unique(names, return_inverse=True, return_counts=True)
    kept = counts[dense] > 1
    return dense[kept].astype(np.int64), at[kept]


def lags(codes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each gram length L: L, the places whose gram of L words came before at a lag that counts for L, and those lags."""
    width = int(codes.max()) + 1 if len(codes) else 1
    names, at = repeated(doc * width + codes, np.arange(len(codes)))
    span = 1
    while len(at):
        if span >= GRAM:
            lag = nearest(names, at)
            counts = (lag > (span // 2 if span > GRAM else 0)) & (lag <= span)
            yield span, at[counts], lag[counts]
        # The gram of twice the length that ends here: its first half ends `span` words before, in the same text as names hold the text.
        before = np.searchsorted(at, at - span)
        before[before == len(at)] = 0
        both = at[before] == at - span
        half, here = names[before[both]], at[both]
        same_doc = doc[here] == doc[here - span]
        pairs = half[same_doc] * (int(names.max()) + 1) + names[both][same_doc]
        names, at = repeated(pairs, here[same_doc])
        span *= 2


def diagonals(span: int, at: np.ndarray, lag: np.ndarray) -> Iterator[tuple[int, Run]]:
    """The runs of one gram length, as their last word and (first word, length, period), by the online DP over words in order."""
    active: dict[int, list[int]] = {}
    for i, d in zip(at.tolist(), lag.tolist()):
        state = active.get(d)
        if state is not None and state[0] == i - 1:
            state[0], state[1] = i, state[1] + 1
            continue
        if state is not None and state[1] + d >= max(LEAST, TIMES * d):
            yield state[0], (state[0] - state[1] - d + 1, state[1] + d, d)
        active[d] = [i, span]
    for d, (last, matched) in active.items():
        if matched + d >= max(LEAST, TIMES * d):
            yield last, (last - matched - d + 1, matched + d, d)


def runs(codes: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> list[list[Run]]:
    """The runs of each text, as (first word, length, period) in order. `codes`: of the words of all texts, one after the other."""
    out: list[list[Run]] = [[] for _ in range(len(starts) - 1)]
    for span, at, lag in lags(codes, doc):
        for last, (start, length, period) in diagonals(span, at, lag):
            text = int(doc[last])
            out[text].append((start - int(starts[text]), length, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def planted(n: int, key: str | None) -> tuple[int, int] | None:
    """The first word and the period of what the check of this operator repeats in a text of `n` words; None for nine keys of ten."""
    h = crc32(key.encode()) if key is not None and n else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def summary(found: list[Run]) -> tuple:
    """n_runs, and start, length, period and exponent of the run with the most periods: exact, ties to the first start and least period."""
    if not found:
        return 0, None, None, None, None
    best = found[0]
    for run in found[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return len(found), *best, 1000 * best[1] // best[2]


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find(df: DataFrame, key: str = "doc_id", text: str = "text", plant: Callable[[int, str | None], tuple[int, int] | None] | None = None) -> DataFrame:
    """Per row: `key`, the runs (array of start, length, period), the collapsed text, and the columns of SCHEMA.

    A word goes if a run holds it after its first period. `plant(n, key)` gives (a, p) where words from `a` on are replaced by those of
    the first `p` from there, again and again, and None where the text is taken as it is.
    """
    df = df.select(key, text)
    run_type = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    fields = [df.schema[key], T.StructField("runs", run_type), T.StructField("collapsed", T.StringType())]
    schema = T.StructType(fields + T._parse_datatype_string(SCHEMA).fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                yield _worked(part, plant)

    return df.mapInArrow(work, schema)


def _worked(part: pa.RecordBatch, plant: Callable | None) -> pa.RecordBatch:
    found = words(part.column(1))
    codes, starts = found.codes, found.starts()
    if plant:
        codes = codes.copy()
        for row, key in enumerate(part.column(0).to_pylist()):
            cut = plant(int(found.counts[row]), None if key is None else str(key))
            if cut:
                a, p = cut
                own = codes[starts[row] : starts[row + 1]]
                own[a:] = np.resize(own[a : a + p], len(own) - a)
    each = runs(codes, found.doc, starts)
    word = found.distinct.to_pylist()
    rows = []
    for row, own in enumerate(each):
        kept = codes[starts[row] : starts[row + 1]]
        if own:
            edges = np.zeros(len(kept) + 1, np.int64)
            for start, length, period in own:
                edges[start + period] += 1
                edges[start + length] -= 1
            kept = kept[np.cumsum(edges)[:-1] == 0]
        collapsed = b" ".join([word[c] for c in kept.tolist()])
        listed = "".join([f"{s},{n},{q}\n" for s, n, q in own]).encode()
        rows.append((own, collapsed, *summary(own), sha256(listed).hexdigest(), sha256(collapsed).hexdigest()))
    column = list(zip(*rows))
    longs = [pa.array(c, pa.int64()) for c in column[2:7]]
    triples = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in own] for own in column[0]], pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])))
    arrays = [part.column(0), triples, pa.array(column[1], pa.binary()).cast(pa.string()), *longs, pa.array(column[7]), pa.array(column[8])]
    names = [part.schema.names[0], "runs", "collapsed", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return pa.RecordBatch.from_arrays(arrays, names)
