"""Byte-level BPE encoding and decoding with a rank file.

Two tiers. A minimal perfect hash over the vocabulary answers whole pre-tokens that are tokens themselves; a pre-token that is
not goes through a heap of adjacent pairs over linked bytes, always merging the lowest rank, leftmost first. Both are exact:
the ids are those of the public rank-file encoders, special tokens being ordinary text.

Text is first cut at single spaces and line ends that stand between two characters that are no white space. The pattern never
matches across such a place, so the pieces can be encoded apart and remembered; pieces seen again cost one dictionary lookup.
The memory of a task is its vocabulary, a bounded number of remembered short pieces, and one Arrow batch.

Defined cases: a null text is empty and has no ids; equal rows stay equal rows; an empty table gives an empty table; any length
of text or pre-token is encoded whole; other columns pass through, and one named like an output is replaced.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MEMO = 250_000  # pieces
LONGEST = 60  # characters of a piece that is remembered
_TOUCHING = re.compile(r" \s|\s |\n\s|\s\n")


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank. The ranks have to be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"the ranks in {path} have gaps")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """A minimal perfect hash: `len(keys)` slots, one key in each.

    Keys are dealt to buckets; a bucket of several keys stores the first seed under which all of them fall in free slots, a
    bucket of one key stores its slot directly (as -slot - 1).
    """

    def __init__(self, keys: list[bytes]):
        from xxhash import xxh64_intdigest as digest

        n = len(keys)
        buckets: list[list[int]] = [[] for _ in range(max(1, n // 3))]
        for i, key in enumerate(keys):
            buckets[digest(key) % len(buckets)].append(i)
        self.steer = [0] * len(buckets)
        self.slots = [-1] * n
        for b in sorted(range(len(buckets)), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if len(own) < 2:
                break
            seed = 1
            while True:
                slots = {digest(keys[i], seed) % n for i in own}
                if len(slots) == len(own) and all(self.slots[s] < 0 for s in slots):
                    break
                seed += 1
            self.steer[b] = seed
            for i in own:
                self.slots[digest(keys[i], seed) % n] = i
        free = (s for s in range(n) if self.slots[s] < 0)
        for b, own in enumerate(buckets):
            if len(own) == 1:
                slot = next(free)
                self.steer[b] = -slot - 1
                self.slots[slot] = own[0]


def finder(keys: list[bytes], steer: list[int], slots: list[int]) -> Callable[[bytes], int]:
    """A function from bytes to the id that a PerfectHash of `keys` gives them, or -1 for bytes that are no key."""
    from xxhash import xxh64_intdigest as digest

    n, width = len(keys), len(steer)

    def find(key: bytes) -> int:
        seed = steer[digest(key) % width]
        i = slots[-seed - 1 if seed < 0 else digest(key, seed) % n] if n else -1
        return i if i >= 0 and keys[i] == key else -1

    return find


def merge_table(tokens: list[bytes]) -> dict[int, int]:
    """(left id << 32 | right id) -> id of the joined token, for every two tokens whose bytes join to a token."""
    by_bytes = {t: i for i, t in enumerate(tokens)}
    out = {}
    for i, token in enumerate(tokens):
        for cut in range(1, len(token)):
            left, right = by_bytes.get(token[:cut]), by_bytes.get(token[cut:])
            if left is not None and right is not None:
                out[left << 32 | right] = i
    return out


def byte_pairs(single: list[int], joined: dict[int, int]) -> list[int]:
    """Rank of every two bytes that join, at (first << 8 | second); -1 for the others."""
    return [joined.get(single[a] << 32 | single[b], -1) for a in range(256) for b in range(256)]


def merge_bytes(piece: bytes, single: list[int], pairs: list[int], joined: dict[int, int]) -> tuple[int, ...]:
    """Ids of one pre-token: a heap of (rank, position) over a doubly linked list of its bytes.

    `due[i]` is the rank at which the node at i joins the next one; an entry of the heap with another rank is out of date.
    """
    n = len(piece)
    ids = [single[b] for b in piece]
    due = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]
    due.append(-1)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [rank << 32 | i for i, rank in enumerate(due) if rank >= 0]
    heapq.heapify(heap)
    join, pop, push = joined.get, heapq.heappop, heapq.heappush
    while heap:
        entry = pop(heap)
        i = entry & 0xFFFFFFFF
        rank = entry >> 32
        if due[i] != rank:
            continue
        j = after[i]
        ids[i], ids[j], due[j] = rank, -1, -1
        after[i] = k = after[j]
        due[i] = -1
        if k < n:
            before[k] = i
            due[i] = r = join(rank << 32 | ids[k], -1)
            if r >= 0:
                push(heap, r << 32 | i)
        k = before[i]
        if k >= 0:
            due[k] = r = join(ids[k] << 32 | rank, -1)
            if r >= 0:
                push(heap, r << 32 | k)
    return tuple([x for x in ids if x >= 0])


class Memo:
    """The pieces seen lately and their ids: at most 2 * MEMO, the older half goes at once."""

    def __init__(self) -> None:
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def get(self, piece: str) -> tuple[int, ...] | None:
        ids = self.young.get(piece)
        return self.old.get(piece) if ids is None else ids

    def put(self, piece: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(piece) > LONGEST:
            return ids
        if len(self.young) >= MEMO:
            self.old, self.young = self.young, {}
        self.young[piece] = ids
        return ids


def encoder(tokens: list[bytes], steer: list[int], slots: list[int], pattern: str) -> Callable[[str], list[int]]:
    """A function from a text to its ids; `steer` and `slots` are those of the tokens' PerfectHash."""
    import regex

    find, matches = finder(tokens, steer, slots), regex.compile(pattern).findall
    single = [find(bytes([b])) for b in range(256)]
    joined = merge_table(tokens)
    pairs = byte_pairs(single, joined)

    pre_tokens, plain, spaced = Memo(), Memo(), Memo()

    def of_pre_token(pre: str) -> tuple[int, ...]:
        if (ids := pre_tokens.get(pre)) is None:
            raw = pre.encode("utf-8", "surrogatepass")
            whole = find(raw)
            ids = pre_tokens.put(pre, (whole,) if whole >= 0 else merge_bytes(raw, single, pairs, joined))
        return ids

    def of_piece(piece: str) -> tuple[int, ...]:
        if (ids := plain.get(piece)) is None:
            ids = plain.put(piece, tuple(chain.from_iterable(map(of_pre_token, matches(piece)))))
        return ids

    def after_space(piece: str) -> tuple[int, ...]:
        if (ids := spaced.get(piece)) is None:
            ids = spaced.put(piece, tuple(chain.from_iterable(map(of_pre_token, matches(" " + piece)))))
        return ids

    line_end = of_pre_token("\n")

    def encode(text: str) -> list[int]:
        if not text:
            return []
        if _TOUCHING.search(text) or text[0].isspace() or text[-1].isspace():
            return list(chain.from_iterable(map(of_pre_token, matches(text))))
        out: list[int] = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            if out:
                out += line_end
            out += of_piece(first)
            young, old = spaced.young, spaced.old
            for piece in rest:
                out += young.get(piece) or old.get(piece) or after_space(piece)
        return out

    return encode


def codec(path: str, pattern: str) -> tuple[list[bytes], list[int], list[int], str]:
    """What `encoder` takes, as plain values, so that tasks can read it where this package isn't installed."""
    tokens = read_ranks(path)
    hashed = PerfectHash(tokens)
    return tokens, hashed.steer, hashed.slots, pattern


def _with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in new}
    return pa.RecordBatch.from_pydict(kept | new)


def _schema(df: DataFrame, new: dict[str, T.DataType]) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name not in new]
    return T.StructType([*kept, *(T.StructField(n, t) for n, t in new.items())])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", verify: bool = False) -> DataFrame:
    """Add the ids of `text` as an array of int; with `verify`, ids that don't decode to the text are an error."""
    shared = df.sparkSession.sparkContext.broadcast(codec(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, tokens = encoder(*shared.value), shared.value[0]
        for batch in batches:
            for part in _slices(batch):
                texts = part.column(text).to_pylist()
                found = [one(x or "") for x in texts]
                if verify and any(b"".join([tokens[i] for i in own]) != (x or "").encode() for own, x in zip(found, texts)):
                    raise ValueError("ids that don't decode to their text")
                yield _with_columns(part, {ids: pa.array(found, pa.list_(pa.int32()))})

    return df.mapInArrow(run, _schema(df, {ids: T.ArrayType(T.IntegerType())}))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that `ids` stand for as a binary column; an id outside the vocabulary is an error."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches:
            for part in _slices(batch):
                found = [b"".join([tokens[i] for i in x or ()]) for x in part.column(ids).to_pylist()]
                yield _with_columns(part, {out: pa.array(found, pa.binary())})

    return df.mapInArrow(run, _schema(df, {out: T.BinaryType()}))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode, decode, and add `n_tokens`, `ids_sha256` and `decoded_sha256`; the ids themselves don't leave the task."""
    shared = df.sparkSession.sparkContext.broadcast(codec(path, pattern))
    new = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value[0]
        one, word, name = encoder(*shared.value), tokens.__getitem__, [str(i) for i in range(len(tokens))].__getitem__
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for value in batch.column(text):
                found = one(value.as_py() or "")
                counts.append(len(found))
                of_ids.append(hashlib.sha256(" ".join(map(name, found)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(b"".join(map(word, found))).hexdigest())
            rest = batch.drop_columns([text])
            yield _with_columns(rest, {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string())})

    kept = T.StructType([f for f in df.schema.fields if f.name != text and f.name not in new])
    return df.mapInArrow(run, T.StructType([*kept.fields, *(T.StructField(n, t) for n, t in new.items())]))


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small batches, so that a result of many ids stays small beside its input."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
