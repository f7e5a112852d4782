"""Token ids in files: an adaptive, context-mixing range coder over independent, checksummed blocks.

Documents are put in order of their id by a range partitioning; every task tokenizes its documents, joins their ids to one stream (the
end id after each document) and writes it in segments. A segment is one row of a Parquet table, so that writes are committed by
Spark and files are read wherever Spark reads: the documents' ids and lengths, where the stream stands, and the payload.

Payload: blocks of `BLOCK` ids, each coded by itself from a fresh model and checked by its own crc32. For every id, the ids that
followed the last one (order 1) and the last two (order 2) before in this block are predictions; how often each was right
lately is its confidence. A table, learned as it goes, mixes the two confidences to the probabilities of "as order 2 says",
"as order 1 says" and "neither"; the id is then coded with the order-0 model, adaptive frequencies of 64 ranges of ids, and
evenly inside the range. The range coder keeps 64 bits and moves 16 at a time. All blocks of a segment are coded side by side,
one array element each, so the work per id is a few dozen array operations.

Text is cut where the tokenizer's pattern never matches across (see `cut`), and the pieces are tokenized by the tokenizers
library once each while they are remembered; a text with other white space is tokenized whole.

Defined cases: a null text is empty and has the end id only; ids are ordered with nulls first, rows of an equal id by a digest of
their text; a table without rows writes none; a damaged block is an error; other columns aren't stored.
"""
from __future__ import annotations

import functools
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelwarrant.llm.shared import shared_dir

BLOCK = 4096  # ids
SEGMENT = 1024 * BLOCK  # ids of a row, unless one document has more
MEMO = 300_000  # pieces
ONE, TWO = 1024, 4096  # slots of the order-1 and order-2 tables of a block
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
#: First ids of the 64 ranges: 4 of 16 ids, then 6 in every doubling up to 65536.
RANGES = np.array([0, 16, 32, 48, *(round(64 * 2 ** (j / 6)) for j in range(60)), 65536])
SIZES = np.diff(RANGES)
OF = np.repeat(np.arange(64), SIZES).astype(np.uint8)
STEP, LIMIT = 24, 1 << 14
_TOUCHING = re.compile(r" \s|\s |\n\s|\s\n")
CUT = ""
SCHEMA = "part int, segment int, docs array<long>, lengths array<int>, start long, n long, payload binary, sizes array<int>, checks array<long>"


class Coder:
    """State of all blocks side by side: range coder, and model. Blocks are coded in lockstep; at every place the first k still have
    ids. Tables are flat: entry (block, slot) stands at block * slots + slot."""

    def __init__(self, blocks: int):
        self.low, self.range = np.zeros(blocks, np.uint64), np.full(blocks, 2**64 - 1, np.uint64)
        self.one, self.two = np.zeros(blocks * ONE, np.uint16), np.zeros(blocks * TWO, np.uint16)
        self.trust1, self.trust2 = np.zeros(blocks * ONE, np.uint8), np.zeros(blocks * TWO, np.uint8)
        self.mixed = np.tile(np.array([2, 1, 4], np.int64), blocks * 32)
        self.seen, self.total = np.full((blocks, 64), 4, np.int32), np.full(blocks, 256, np.int64)
        self.last, self.before = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
        self.blocks = np.arange(blocks)

    def predict(self, k: int) -> tuple[np.ndarray, ...]:
        """Slots of both orders, their predictions, and where the weights of their confidences begin."""
        block, last = self.blocks[:k], self.last[:k]
        slot1 = block * ONE + ((last * 40503 >> 5) & (ONE - 1))
        slot2 = block * TWO + ((last * 40503 + self.before[:k] * 30011 >> 4) & (TWO - 1))
        p1, p2 = self.one.take(slot1), self.two.take(slot2)
        t1, t2 = self.trust1.take(slot1), self.trust2.take(slot2)
        state = np.minimum(t2, 3) * np.uint8(4) + np.minimum(t1, 3) + (p1 == p2) * np.uint8(16)
        return slot1, slot2, p1, p2, (block * 32 + state) * 3

    def weights(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.mixed.take(at), self.mixed.take(at + 1), self.mixed.take(at + 2)

    def learn(self, x: np.ndarray, found: tuple[np.ndarray, ...], kind: np.ndarray, total: np.ndarray) -> None:
        slot1, slot2, p1, p2, at = found
        for table, trust, slot, p in ((self.one, self.trust1, slot1, p1), (self.two, self.trust2, slot2, p2)):
            table[slot] = x
            trust[slot] = np.minimum(trust.take(slot), 200) * (p == x) + (p == x)
        self.mixed[at + kind] += STEP
        full = at[total > LIMIT - STEP]
        for j in range(3 * (len(full) > 0)):
            self.mixed[full + j] = (self.mixed[full + j] + 1) >> 1
        k = len(x)
        self.before[:k] = self.last[:k]
        self.last[:k] = x

    def learn_range(self, on: np.ndarray, r: np.ndarray) -> None:
        self.seen[on, r] += STEP
        total = self.total[on] + STEP
        self.total[on] = total
        full = on[total > LIMIT]
        if len(full):
            self.seen[full] = (self.seen[full] + 1) >> 1
            self.total[full] = self.seen[full].sum(1)


class Writer(Coder):
    def __init__(self, blocks: int, most: int):
        super().__init__(blocks)
        self.out, self.at = np.zeros((blocks, most * 3 + 8), ">u2"), np.zeros(blocks, np.int64)

    def put(self, on: np.ndarray | slice, first: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        part = self.range[on] // total.astype(np.uint64)
        low, rng = self.low[on] + part * first.astype(np.uint64), part * size.astype(np.uint64)
        while True:
            move = (low ^ (low + rng)) < TOP
            short = ~move & (rng < BOTTOM)
            if short.any():
                rng[short] = (~low[short] + np.uint64(1)) & (BOTTOM - np.uint64(1))
                move |= short
            go = np.flatnonzero(move)
            if not len(go):
                break
            lanes = go if isinstance(on, slice) else on[go]
            self.out[lanes, self.at[lanes]] = low[go] >> np.uint64(48)
            self.at[lanes] += 1
            low[go] <<= np.uint64(16)
            rng[go] <<= np.uint64(16)
        self.low[on], self.range[on] = low, rng

    def end(self) -> None:
        for _ in range(4):
            self.out[np.arange(len(self.at)), self.at] = self.low >> np.uint64(48)
            self.at += 1
            self.low <<= np.uint64(16)


class Reader(Coder):
    def __init__(self, raw: np.ndarray, starts: np.ndarray):
        super().__init__(len(starts))
        self.raw, self.at = raw, starts.copy()
        self.code = np.zeros(len(starts), np.uint64)
        for _ in range(4):
            self.code = self.code << np.uint64(16) | self.raw[self.at]
            self.at += 1

    def place(self, on: np.ndarray | slice, total: np.ndarray) -> np.ndarray:
        """Where the next symbol lies, 0 to total - 1."""
        self.part = self.range[on] // total.astype(np.uint64)
        return np.minimum((self.code[on] - self.low[on]) // self.part, (total - 1).astype(np.uint64)).astype(np.int64)

    def take(self, on: np.ndarray | slice, first: np.ndarray, size: np.ndarray) -> None:
        low, rng, code = self.low[on] + self.part * first.astype(np.uint64), self.part * size.astype(np.uint64), self.code[on]
        while True:
            move = (low ^ (low + rng)) < TOP
            short = ~move & (rng < BOTTOM)
            if short.any():
                rng[short] = (~low[short] + np.uint64(1)) & (BOTTOM - np.uint64(1))
                move |= short
            go = np.flatnonzero(move)
            if not len(go):
                break
            lanes = go if isinstance(on, slice) else on[go]
            code[go] = code[go] << np.uint64(16) | self.raw[self.at[lanes]]
            self.at[lanes] += 1
            low[go] <<= np.uint64(16)
            rng[go] <<= np.uint64(16)
        self.low[on], self.range[on], self.code[on] = low, rng, code


def _going(n: int, t: int) -> int:
    """Blocks that have an id at place t; only the last one may be short."""
    blocks = -(-n // BLOCK)
    return blocks if t < n - (blocks - 1) * BLOCK else blocks - 1


def compress(ids: np.ndarray) -> tuple[bytes, list[int], list[int]]:
    """Payload, bytes of every block, and crc32 of every block's ids (as little-endian unsigned 32-bit integers)."""
    n = len(ids)
    if not n:
        return b"", [], []
    blocks = -(-n // BLOCK)
    ones = np.ones(blocks, np.int64)
    padded = np.zeros(blocks * BLOCK, np.int64)
    padded[:n] = ids
    table = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    coder = Writer(blocks, min(n, BLOCK))
    for t in range(min(n, BLOCK)):
        k = _going(n, t)
        x = table[t, :k]
        found = coder.predict(k)
        kind = np.where(found[3] == x, 0, 2 - (found[2] == x))
        w0, w1, w2 = coder.weights(found[4])
        total = w0 + w1 + w2
        coder.put(slice(k), np.where(kind > 0, w0, 0) + np.where(kind > 1, w1, 0), np.where(kind == 0, w0, np.where(kind == 1, w1, w2)), total)
        new = np.flatnonzero(kind == 2)
        if len(new):
            r = OF.take(x[new]).astype(np.int64)
            sums, size = np.cumsum(coder.seen[new], 1, dtype=np.int32), coder.seen[new, r]
            coder.put(new, sums[coder.blocks[: len(new)], r] - size, size, coder.total[new])
            coder.put(new, x[new] - RANGES.take(r), ones[: len(new)], SIZES.take(r))
            coder.learn_range(new, r)
        coder.learn(x, found, kind, total)
    coder.end()
    raw = [coder.out[b, : coder.at[b]].tobytes() for b in range(blocks)]
    checks = [zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) for b in range(blocks)]
    return b"".join(raw), [len(x) for x in raw], checks


def decompress(payload: bytes, sizes: list[int], checks: list[int], n: int) -> np.ndarray:
    """The ids; ValueError if a block isn't what was written."""
    if not n:
        return np.zeros(0, np.int64)
    raw = np.append(np.frombuffer(payload[: len(payload) // 2 * 2], ">u2").astype(np.uint64), np.zeros(4 * BLOCK, np.uint64))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) // 2
    blocks = -(-n // BLOCK)
    if len(sizes) != blocks or len(checks) != blocks or sum(sizes) != len(payload):
        raise ValueError("a segment of another length than it states")
    coder = Reader(raw, starts)
    ones = np.ones(blocks, np.int64)
    table = np.zeros((min(n, BLOCK), blocks), np.int64)
    for t in range(min(n, BLOCK)):
        k = _going(n, t)
        found = coder.predict(k)
        w0, w1, w2 = coder.weights(found[4])
        total = w0 + w1 + w2
        at = coder.place(slice(k), total)
        kind = (at >= w0).astype(np.int64) + (at >= w0 + w1)
        coder.take(slice(k), np.where(kind > 0, w0, 0) + np.where(kind > 1, w1, 0), np.where(kind == 0, w0, np.where(kind == 1, w1, w2)))
        x = np.where(kind == 0, found[3], found[2]).astype(np.int64)
        new = np.flatnonzero(kind == 2)
        if len(new):
            sums = np.cumsum(coder.seen[new], 1, dtype=np.int32)
            r = (sums <= coder.place(new, coder.total[new]).astype(np.int32)[:, None]).sum(1)
            size = coder.seen[new, r]
            coder.take(new, sums[coder.blocks[: len(new)], r] - size, size)
            inside = coder.place(new, SIZES.take(r))
            coder.take(new, inside, ones[: len(new)])
            x[new] = RANGES.take(r) + inside
            coder.learn_range(new, r)
        coder.learn(x, found, kind, total)
        table[t, :k] = x
    ids = table.T.reshape(-1)[:n] if n <= BLOCK else np.concatenate([table.T[:-1].reshape(-1), table.T[-1][: n - (blocks - 1) * BLOCK]])
    for b in range(blocks):
        if zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) != checks[b]:
            raise ValueError(f"block {b} of a segment is damaged")
    return ids


def cut(text: str) -> list[str] | None:
    """Pieces that are tokenized alike apart: cut before every space and around every line end that stand between characters that
    are no white space. None if the text has white space elsewhere or holds the mark used for cutting."""
    if CUT in text or _TOUCHING.search(text) or text[:1].isspace() or text[-1:].isspace():
        return None
    return text.replace(" ", CUT + " ").replace("\n", f"{CUT}\n{CUT}").split(CUT)


@functools.lru_cache(maxsize=1)
def tokenizer(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids, each as little-endian 16-bit integers. The tasks of a process share it and the pieces it
    remembers; it keeps to the thread of its task, as threads of the library's own would each hold memory."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    if own.get_vocab_size() > 1 << 16:
        raise ValueError("ids of more than 16 bits")
    memo: dict[str, bytes] = {}

    def many(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in own.encode_batch_fast(texts, add_special_tokens=False)]

    def run(texts: list[str]) -> list[bytes]:
        nonlocal memo
        pieces = [cut(t) for t in texts]
        new = list({p for own_ in pieces if own_ for p in own_ if p not in memo})
        if len(memo) + len(new) > MEMO:
            memo = {}
            new = list({p for own_ in pieces if own_ for p in own_})
        memo.update(zip(new, many(new)))
        whole = iter(many([t for t, own_ in zip(texts, pieces) if own_ is None]))
        get = memo.__getitem__
        return [next(whole) if own_ is None else b"".join(map(get, own_)) for own_ in pieces]

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Write the ids of `docs`, in ascending order of `key`, to a new folder `path`."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, part = tokenizer(tokenizer_path), np.array([end_id], "<u2").tobytes(), TaskContext.get().partitionId()
        ids, stream, done, segment = [], [], 0, 0

        def row() -> pa.RecordBatch:
            lengths = [len(s) // 2 for s in stream]
            all_ids = np.frombuffer(b"".join(stream), "<u2").astype(np.int64)
            payload, sizes, checks = compress(all_ids)
            columns = ([part], [segment], [ids], [lengths], [done], [len(all_ids)], [payload], [sizes], [checks])
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            names = ("part", "segment", "docs", "lengths", "start", "n", "payload", "sizes", "checks")
            return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})

        held = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                some = batch.slice(start, 128)
                for doc, raw in zip(some.column("id").to_pylist(), own(some.column("text").to_pylist())):
                    ids.append(doc)
                    stream.append(raw + end)
                    held += len(raw) // 2 + 1
                    if held >= SEGMENT:
                        yield row()
                        done, segment, ids, stream, held = done + held, segment + 1, [], [], 0
        if ids:
            yield row()

    ordered.mapInArrow(run, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the folder: id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row per partition that was written
    before = dict(zip((r.part for r in totals), np.concatenate([[0], np.cumsum([r.n for r in totals])[:-1]]).tolist() if totals else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, _, docs, lengths, start, n, payload, sizes, checks = (batch.column(j)[i].as_py() for j in range(9))
                ids = decompress(payload, sizes, checks, n).astype("<u4")
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - m : e].tobytes()) for e, m in zip(ends, lengths)]
                starts = before[part] + start + ends - np.array(lengths)
                yield pa.RecordBatch.from_pydict({"id": pa.array(docs, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    return rows.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
