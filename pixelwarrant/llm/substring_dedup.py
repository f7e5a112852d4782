"""Substring dedup: words inside passages that recur, in one text or in several, go.

A window is `window` consecutive words. It recurs if the same words start at another place too.

1. Anchors. Of the grams of a third of a window (and a word) in a window, the one of least hash is its anchor, so equal windows have
   equal anchors. Only the grams that are anchors, about one at every twelfth word, are counted over all texts.
2. Confirm. Windows whose anchor is met twice are counted by 128-bit digests; what is counted twice recurs. Counting sums in the
   tasks first, so a passage that most texts share is one row for each task. Each recurring window is laid to one text that holds it,
   and its windows there, joined where they touch, are the recurring passages.
3. Compile. Passages are dealt to shards of about `SHARD` words, which grow in number with the text and not in size; those of one text
   stay together. Each passage is cut into blocks of half a window (and a word), and any window inside it holds a whole block. A
   shard's blocks become an Aho-Corasick automaton in which each word is a few letters.
4. Locate. Every text is streamed through the automata of the shards that hold one of its anchors (no other shard can match), each
   taking the stretches around those anchors. Where a block is met, text and passage are compared to both sides, and what is equal for a window or more is an occurrence; the places
   of all are put together. A shard that many texts go to is split: the texts are dealt over several tasks, and the shard's
   passages go to each.

Two Bloom filters of bounded size (`bloom`) keep anchors and texts that can't matter from being shuffled; joins decide after them.

Texts with equal words are one class throughout; where a class has two texts or more, all its windows recur. Defined cases: a null
text has no words; fewer words than a window: nothing goes; repeated rows and keys, null ones too, each get their result; an
empty table gives an empty one; columns other than the key and the text aren't returned.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelwarrant.llm import bloom
from pixelwarrant.llm.shared import stored
from pixelwarrant.llm.words import SEED, Words, chunks, words

SHARD = 200_000  # words of one automaton's passages, about
LONG = 20_000  # windows of one text that stay together; more are cut, with overlap
TASK_BYTES = 8_000_000  # of text that goes through one automaton in one task
SPELL, DIGITS = 3, 100  # letters of a word and their number: 1,000,000 words in one automaton
FIRST, SECOND = 33, 150  # where the letters that begin a word start, and the others
UNKNOWN = "\0" * SPELL
_BASE = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = sha256(b"").hexdigest()


# ---- hashes of grams and windows


def spread(values: np.ndarray, width: int, join: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Values of all stretches of `width` neighbours, from those of shorter stretches: join(left, right, length of the right)."""
    out, have, part, size = None, 0, values, 1
    while True:
        if width & size:
            if out is None:
                out, have = part, size
            else:
                n = len(values) - have - size + 1
                out, have = join(out[:n], part[have : have + n], size), have + size
        if size * 2 > width:
            return out
        n = len(values) - 2 * size + 1
        part, size = join(part[:n], part[size : size + n], size), size * 2


def grams(keys: np.ndarray, width: int) -> np.ndarray:
    """A hash of each stretch of `width` keys."""

    def join(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
        return left * np.uint64(pow(int(_BASE), size, 1 << 64)) + right

    if len(keys) < width:
        return np.zeros(0, np.uint64)
    out = spread(keys, width, join).copy()
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


class Windows:
    """The windows of a chunk of texts: where they start, their anchors and digests."""

    def __init__(self, found: Words, window: int):
        self.found, self.window = found, window
        self.one = found.keys(SEED)[found.codes]
        doc = found.doc
        n = max(0, len(doc) - window + 1)
        self.inside = doc[:n] == doc[window - 1 :] if n else np.zeros(0, bool)
        self.gram = window // 3 + 1
        self.hashes = grams(self.one, self.gram) | np.uint64(1)
        least = spread(self.hashes, window - self.gram + 1, lambda x, y, _: np.minimum(x, y)) if n else np.zeros(0, np.uint64)
        self.anchors = np.where(self.inside, least, np.uint64(0))

    def places(self) -> np.ndarray:
        """The places of all grams that are the anchor of a window."""
        width = self.window - self.gram + 1
        if not len(self.anchors):
            return np.zeros(0, np.int64)
        padded = np.concatenate([np.zeros(width - 1, np.uint64), self.anchors, np.zeros(width - 1, np.uint64)])
        best = spread(padded, width, lambda x, y, _: np.maximum(x, y))
        return np.flatnonzero(best == self.hashes[: len(best)])

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        two = self.found.keys(SEED + 1)[self.found.codes]
        return grams(self.one, self.window).view(np.int64), grams(two, self.window).view(np.int64)


# ---- one row for every text


def normal(text: bytes | None) -> bytes:
    return b" ".join((text or b"").split())


def digest(plain: bytes) -> tuple[int, int]:
    """Two signed 64-bit numbers of a text's words."""
    from xxhash import xxh3_128_digest

    raw = xxh3_128_digest(plain, SEED)
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def _lists(ends: np.ndarray, flat: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def signatures(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """key, t1 and t2 (digest of the words), n_words, plain_sha256, and the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                plain = [normal(x) for x in part.column(1).cast(pa.large_binary()).to_pylist()]
                found = words(pa.array(plain, pa.large_binary()))
                w = Windows(found, window)
                at = w.places()
                ends = np.concatenate([[0], np.cumsum(np.bincount(found.doc[at], minlength=len(plain)))])
                t = [digest(p) for p in plain]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x[0] for x in t], pa.int64()), pa.array([x[1] for x in t], pa.int64()), pa.array(found.counts, pa.int64()), pa.array([sha256(p).hexdigest() for p in plain], pa.string()), _lists(ends, pa.array(w.hashes[at].view(np.int64)))],
                    [key, "t1", "t2", "n_words", "plain_sha256", "anchors"],
                )

    docs = docs.select(key, text)
    fields = T._parse_datatype_string("t1 long, t2 long, n_words long, plain_sha256 string, anchors array<long>").fields
    return docs.mapInArrow(run, T.StructType([docs.schema[key], *fields]))


def texts_of(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """t1, t2 and the words (`plain`, one space between) of the classes whose t1 is in `wanted`, with its other columns."""
    known = docs.sparkSession.sparkContext.broadcast(bloom.build(wanted, ["t1"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0):
                plain = [normal(x) for x in part.column(0).cast(pa.large_binary()).to_pylist()]
                t1, t2 = np.array([digest(p) for p in plain], np.int64).T
                at = np.flatnonzero(bloom.passes(known.value, [np.ascontiguousarray(t1)]))
                yield pa.RecordBatch.from_arrays([pa.array(t1[at]), pa.array(t2[at]), pa.array([plain[i] for i in at.tolist()], pa.binary())], ["t1", "t2", "plain"])

    named = docs.select(text).mapInArrow(run, "t1 long, t2 long, plain binary")
    return named.join(wanted, "t1").dropDuplicates(["t1", "t2"])


def met_anchors(classes: DataFrame) -> DataFrame:
    """t1 and a: the anchors of each class that occur twice or more, in one text or several."""
    each = classes.select(F.explode("anchors").alias("a"))
    often = stored(each.groupBy("a").count().where("count > 1").select("a"))
    known = classes.sparkSession.sparkContext.broadcast(bloom.build(often, ["a"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column(1).flatten().to_numpy()
            at = np.flatnonzero(bloom.passes(known.value, [a]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pc.list_parent_indices(batch.column(1)).take(pa.array(at))), pa.array(a[at])], ["t1", "a"])

    return classes.select("t1", "anchors").mapInArrow(run, "t1 long, a long").distinct().join(often, "a", "left_semi")


# ---- recurring windows and passages


def recurring(texts: DataFrame, window: int) -> DataFrame:
    """d1, d2 and `rep`, the least t1 of the texts that hold the window, of all windows that occur twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                w = Windows(words(part.column(1)), window)
                at = np.flatnonzero(w.inside & np.isin(w.anchors, part.column(2).flatten().to_numpy().view(np.uint64)))
                d1, d2 = w.digests()
                yield pa.RecordBatch.from_arrays([pa.array(d1[at]), pa.array(d2[at]), part.column(0).take(pa.array(w.found.doc[at]))], ["d1", "d2", "t1"])

    found = texts.select("t1", "plain", "met").mapInArrow(run, "d1 long, d2 long, t1 long")
    return found.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("t1").alias("rep")).where("n > 1").drop("n")


def passages(texts: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """passage (words, one space between), n (words), anchors, and `part`, alike for those of one text: each recurring window is in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                w = Windows(words(part.column(1)), window)
                d1, d2 = w.digests()
                own = [set(zip(x, y)) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                doc, starts, places = w.found.doc, w.found.starts(), [[] for _ in own]
                for i in np.flatnonzero(w.inside & np.isin(d1, part.column(2).flatten().to_numpy())).tolist():
                    row, pair = doc[i], (int(d1[i]), int(d2[i]))
                    if pair in own[row]:
                        own[row].remove(pair)  # its first place alone
                        places[row].append(i)
                out = []
                for row, at in enumerate(places):
                    if not at:
                        continue
                    at, begin = np.array(at), int(starts[row])
                    plain, t1 = part.column(1)[row].as_py().split(b" "), part.column(0)[row].as_py()
                    turns = (np.diff(at) > 1) | (np.diff(np.arange(len(at)) // LONG) > 0)
                    for piece in np.split(np.arange(len(at)), np.flatnonzero(turns) + 1):
                        first, last = int(at[piece[0]]), int(at[piece[-1]])
                        anchors = np.unique(w.anchors[first : last + 1]).view(np.int64)
                        out.append((b" ".join(plain[first - begin : last - begin + window]), last - first + window, anchors, f"{t1} {piece[0] // LONG}"))
                kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], ["passage", "n", "anchors", "part"])

    lists = windows.groupBy("rep").agg(F.collect_list("d1").alias("d1"), F.collect_list("d2").alias("d2"))
    joined = texts.select("t1", "plain").join(lists, F.col("t1") == F.col("rep")).select("t1", "plain", "d1", "d2")
    return joined.mapInArrow(run, "passage binary, n long, anchors array<long>, part string")


# ---- automata


def spelling(number: int) -> str:
    """`SPELL` letters for a word's number."""
    last = "".join([chr(SECOND + number // DIGITS**i % DIGITS) for i in range(SPELL - 1)])
    return chr(FIRST + number // DIGITS ** (SPELL - 1)) + last


def shared_length(a: bytes, i: int, b: bytes, j: int) -> int:
    """How many bytes of `a` from i and of `b` from j are equal: the first difference is the highest bit in which two numbers differ."""
    n, done, step = min(len(a) - i, len(b) - j), 0, 128
    while done < n:
        k = min(step, n - done)
        x, y = a[i + done : i + done + k], b[j + done : j + done + k]
        if x != y:
            return done + (8 * k - (int.from_bytes(x) ^ int.from_bytes(y)).bit_length()) // 8
        done, step = done + k, min(4 * step, 1 << 16)
    return done


class Passages:
    """The automaton of the blocks of some passages, and what it takes to tell whole occurrences.

    A word is spelled in `SPELL` letters: the first of `DIGITS` of their own, the others of `DIGITS` more, so that a match can't start inside
    a word. An automaton looks for a letter among a node's branches one by one, which is fast only in a small alphabet.
    """

    def __init__(self, passages: list[bytes], window: int):
        from ahocorasick import STORE_ANY, Automaton

        self.window, self.block = window, window // 2 + 1
        if 2 * self.block - 1 > window:
            self.block -= 1
        self.letters: dict[bytes, str] = {}
        self.spelled = ["".join([self.letters.get(w) or self.letters.setdefault(w, spelling(len(self.letters))) for w in p.split(b" ")]) for p in passages]
        self.forward = [s.encode("latin-1") for s in self.spelled]
        self.backward = [s[::-1] for s in self.forward]
        self.automaton = Automaton(STORE_ANY)
        blocks: dict[str, list[tuple[int, int]]] = {}
        for k, s in enumerate(self.spelled):
            for at in range(0, len(s) // SPELL - self.block + 1, self.block):
                blocks.setdefault(s[at * SPELL : (at + self.block) * SPELL], []).append((k, at))
        for block, places in blocks.items():
            self.automaton.add_word(block, places)
        self.automaton.make_automaton()

    def spans(self, plain: bytes) -> tuple[list[int], list[int]]:
        """First words, and words after the last, of the stretches of a text that occurrences cover."""
        text = "".join([self.letters.get(w, UNKNOWN) for w in plain.split(b" ")])
        raw, n = text.encode("latin-1"), len(text) // SPELL
        back = raw[::-1]
        reached: dict[tuple[int, int], int] = {}  # for a passage laid at a place: the last word compared
        found = []
        for end, places in self.automaton.iter(text) if self.spelled else ():
            last = (end + 1) // SPELL - 1
            start = last + 1 - self.block
            for k, at in places:
                if reached.get((k, start - at), -1) >= last:
                    continue
                right = shared_length(raw, (last + 1) * SPELL, self.forward[k], (at + self.block) * SPELL) // SPELL
                left = shared_length(back, (n - start) * SPELL, self.backward[k], len(self.forward[k]) - at * SPELL) // SPELL
                reached[k, start - at] = last + right
                if left + self.block + right >= self.window:
                    found.append((start - left, last + 1 + right))
        starts, ends = [], []
        for a, b in sorted(found):
            if ends and a <= ends[-1]:
                ends[-1] = max(b, ends[-1])
            else:
                starts.append(a)
                ends.append(b)
        return starts, ends


def segments(texts: DataFrame, routes: DataFrame, window: int) -> DataFrame:
    """The stretches of a text that a shard can match: shard, t1, t2, first word, words. `routes` has `keys` (shard, a) of each t1."""
    gram = window // 3 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2):
                w = Windows(words(part.column(2)), window)
                places, starts, out = w.places(), w.found.starts(), []
                ends = np.searchsorted(places, starts)
                for row in range(part.num_rows):
                    own = places[ends[row] : ends[row + 1]]
                    hashes, inside = w.hashes[own].view(np.int64), own - starts[row]
                    found, keys = part.column(2)[row].as_py().split(b" "), part.column(3)[row].values
                    shards, anchors = keys.field(0).to_numpy(), keys.field(1).to_numpy()
                    for shard in np.unique(shards):
                        at = inside[np.isin(hashes, anchors[shards == shard])]
                        if not len(at):
                            continue
                        # All windows with a gram as their anchor lie around it; stretches that touch are one.
                        for piece in np.split(at, np.flatnonzero(np.diff(at) > 2 * window - gram) + 1):
                            first, end = max(0, int(piece[0]) - window + gram), int(piece[-1]) + window
                            out.append((int(shard), row, first, b" ".join(found[first:end])))
                row = pa.array([o[1] for o in out], pa.int64())
                arrays = [pa.array([o[0] for o in out], pa.int32()), part.column(0).take(row), part.column(1).take(row), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "t1", "t2", "first", "words"])

    joined = texts.select("t1", "t2", "plain").join(routes, "t1").select("t1", "t2", "plain", "keys")
    return joined.mapInArrow(run, "shard int, t1 long, t2 long, first int, words binary")


def located(texts: DataFrame, met: DataFrame, shards: DataFrame, window: int) -> DataFrame:
    """t1, t2, starts and ends of the covered stretches, for each text and shard. `met`: the different anchors (a) of each t1."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"t1": [], "t2": [], "starts": [], "ends": []}
        if left.num_rows and right.num_rows:
            made = Passages(right["passage"].to_pylist(), window)
            for t1, t2, first, plain in zip(*(left[c].to_pylist() for c in ("t1", "t2", "first", "words"))):
                starts, ends = made.spans(plain)
                if starts:
                    for name, value in zip(out, (t1, t2, [first + s for s in starts], [first + e for e in ends])):
                        out[name].append(value)
        return pa.table(out, pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]))

    holders = shards.select("shard", F.explode("anchors").alias("a")).distinct()
    routes = met.join(holders, "a").groupBy("t1").agg(F.collect_list(F.struct("shard", "a")).alias("keys"))
    sent = stored(segments(texts, routes, window))
    # How many tasks share a shard's texts: a row for each shard.
    salts = stored(sent.groupBy("shard").agg(F.ceil(F.sum(F.length("words")) / TASK_BYTES).cast("int").alias("salts")))
    salt = F.pmod(F.xxhash64("t2", "first"), F.col("salts")).cast("int").alias("salt")
    left = sent.join(salts, "shard").select("t1", "t2", "shard", "first", "words", salt)
    right = shards.select("shard", "passage").join(salts, "shard").select("shard", "passage", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    both = left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt"))
    return both.applyInArrow(run, "t1 long, t2 long, starts array<int>, ends array<int>")


def collapsed(texts: DataFrame, places: DataFrame) -> DataFrame:
    """t1, t2, n_removed, kept_sha256 and the spans that go, of every text that loses words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for plain, starts, ends in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                found = plain.split(b" ")
                edges = np.bincount(starts, minlength=len(found) + 1) - np.bincount(ends, minlength=len(found) + 1)
                gone = np.cumsum(edges)[:-1] > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                kept = b" ".join([found[i] for i in np.flatnonzero(~gone).tolist()])
                rows.append((int(gone.sum()), sha256(kept).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)]))
            kinds = (pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["t1", "t2", "n_removed", "kept_sha256", "spans"])

    each = places.groupBy("t1", "t2").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    joined = texts.select("t1", "t2", "plain").join(each, ["t1", "t2"])
    return joined.mapInArrow(run, "t1 long, t2 long, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long>>")


def find(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """Per row: `key`, n_words, n_removed, kept_sha256, and `spans` (first word, word after the last) of what goes."""
    rows = stored(signatures(df, key, text, window))
    classes = stored(rows.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.first("anchors").alias("anchors")))
    met = stored(met_anchors(classes))
    texts = stored(texts_of(df, text, met.groupBy("t1").agg(F.collect_list("a").alias("met"))))
    windows = stored(recurring(texts, window))
    found = stored(passages(texts, windows, window))
    n = max(1, -(-(found.agg(F.sum("n")).first()[0] or 0) // SHARD))
    shards = found.withColumn("shard", F.pmod(F.xxhash64("part"), F.lit(n)).cast("int"))
    alone = texts.join(classes.where("copies = 1").select("t1", "t2"), ["t1", "t2"], "left_semi")
    of_alone = met.join(alone.select("t1").distinct(), "t1", "left_semi")
    places = stored(located(alone, of_alone, shards, window))
    found = classes.select("t1", "t2", "copies").join(collapsed(texts, places), ["t1", "t2"], "left")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= window)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    return rows.drop("anchors").join(found, ["t1", "t2"]).select(
        key,
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "plain_sha256")).alias("kept_sha256"),
        F.when(whole, all_of_it).otherwise(F.coalesce("spans", F.array())).alias("spans"),
    )
