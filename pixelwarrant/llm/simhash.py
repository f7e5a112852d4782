"""Near-duplicates by SimHash, found with the generalised pigeonhole principle.

A fingerprint bit is set if it is set in more than half of the hashes of a text's word shingles. All pairs of distinct
fingerprints within `bits` differing bits are found:

1. Correlated bits are grouped into parts. Bits that move together make the values of a part few and its other bits no better,
   so they are kept together and leave the other parts discriminating.
2. With thresholds t_1..t_m, one per part, that sum to bits - m + 1 (-1: the part is not looked at), two fingerprints within
   `bits` differ by at most t_i in some part i. For every fingerprint, dynamic programming picks the thresholds with the fewest
   estimated candidates, so a part value that very many share is passed over by those who have a cheaper choice.
3. Every fingerprint is indexed once per part; every fingerprint probes the values within t_i of its own. One join on
   (part, value) brings both together and counts the differing bits in its condition, so only verified links leave it.

The number of parts follows from the number of fingerprints by the same estimate; it changes the work, never the links.

Defined cases: a null or wordless text has fingerprint zero and links like any other; a text with fewer words than a shingle is
one shingle; repeated rows and ids stay as they are; an empty table gives an empty one; the least id of a group names it (nulls
last); other columns pass through, and one named like an output is replaced.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelwarrant.llm.components import components
from pixelwarrant.llm.shared import stored

SEED = 42
BLOCK = 8  # bits of the blocks whose value frequencies give the estimates
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CHUNK = 8192  # shingles whose bits are counted at once


def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit fingerprint of one text."""
    from xxhash import xxh64_digest

    text = text or ""
    found = WORDS.findall(text.lower() if text.isascii() else text.translate(LOWER))
    if not found:
        return 0
    if len(found) < words:
        shingles: Iterator[str] = iter([" ".join(found)])
        n = 1
    else:
        shingles = map(" ".join, zip(*(found[i:] for i in range(words))))
        n = len(found) - words + 1
    counts = np.zeros(64, np.int64)
    hashes = [xxh64_digest(s, SEED) for s in shingles]
    for start in range(0, n, CHUNK):
        raw = np.frombuffer(b"".join(hashes[start : start + CHUNK]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(df: DataFrame, text: str = "text", words: int = 3, out: str = "fp") -> DataFrame:
    """Replace `text` by its fingerprint, a long."""
    kept = [f for f in df.schema.fields if f.name not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py(), words) for x in batch.column(text)]
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in kept} | {out: pa.array(values, pa.int64())})

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.LongType())]))


def _counted(fps: DataFrame, size: int, count: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all fingerprints of what `count` makes of a matrix of bits: `size` numbers, summed in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                total += count(bit_matrix(batch.slice(start, CHUNK).column(0).to_numpy(zero_copy_only=False)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(size, np.int64)
    for row in fps.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # `size` rows at most
        out[row.slot] = row.n
    return out


def bit_matrix(fps: np.ndarray) -> np.ndarray:
    """One row of 64 bits, the highest first, per fingerprint."""
    raw = np.ascontiguousarray(fps.astype(">i8")).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1)


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Deal 64 bits (0: highest) to `parts` groups of nearly equal size, the most correlated together."""
    p = np.diag(together) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(together / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, out = set(range(64)), []
    for k in range(parts):
        want = 64 // parts + (k < 64 % parts)
        own = [max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))]
        free.discard(own[0])
        while len(own) < want:
            best = max(free, key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            free.discard(best)
        out.append(sorted(own))
    return out


def gather(bits: np.ndarray, group: list[int]) -> np.ndarray:
    """The value of a part, from a matrix of bits."""
    out = np.zeros(len(bits), np.int64)
    for b in group:
        out = out << 1 | bits[:, b]
    return out


def balls(width: int, radius: int) -> np.ndarray:
    """All values of `width` bits with at most `radius` bits set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def distances(seen: np.ndarray, most: int) -> np.ndarray:
    """[value, d]: share of fingerprints whose value differs from `value` in exactly d bits, d up to `most`."""
    at = np.arange(len(seen), dtype=np.uint16)
    ones = np.bitwise_count(at)
    table = np.zeros((len(seen), most + 1))
    for x in at[ones <= most]:
        table[:, ones[x]] += seen[at ^ x]
    return table / max(1, seen.sum())


def allocate(cost: np.ndarray, total: int) -> np.ndarray:
    """Per row the thresholds, -1 or more, that sum to `total` at the least summed cost.

    cost[row, part, t + 1] is that of threshold t; that of -1 has to be 0. Dynamic programming over the parts.
    """
    rows, parts, options = cost.shape
    span = total + parts  # the sum of t + 1 over all parts
    best = np.full((parts + 1, rows, span + 1), np.inf)
    best[0, :, 0] = 0
    choice = np.zeros((parts, rows, span + 1), np.int8)
    for i in range(parts):
        for s in range(span + 1):
            for t in range(min(options, s + 1)):
                new = best[i, :, s - t] + cost[:, i, t]
                better = new < best[i + 1, :, s]
                best[i + 1, better, s], choice[i, better, s] = new[better], t
    out, left = np.zeros((rows, parts), np.int8), np.full(rows, span)
    for i in range(parts - 1, -1, -1):
        out[:, i] = choice[i, np.arange(rows), left]
        left = left - out[:, i]
    return out - 1


def best_parts(n: int, bits: int) -> int:
    """The number of parts with the least work for evenly spread fingerprints: probes, plus candidates."""

    def work(m: int) -> float:
        width, total = 64 // m, 0.0
        each, more = divmod(bits - m + 1, m)
        for i in range(m):
            probes = len(balls(width, each + (i < more))) if each + (i < more) >= 0 else 0
            total += probes * (2 + n / 2.0**width)
        return total

    return min(range(2, min(8, bits + 1) + 1), key=work) if bits else 1


def links(fps: DataFrame, bits: int = 3, parts: int | None = None, fp: str = "fp") -> DataFrame:
    """Pairs a < b of distinct fingerprints that differ in at most `bits` bits. `fps` must hold each fingerprint once."""
    fps = fps.select(fp)

    def pairs_set(one: np.ndarray) -> np.ndarray:
        wide = one.astype(np.float32)
        return np.append((wide.T @ wide).astype(np.int64).ravel(), len(one))

    *together, n = _counted(fps, 64 * 64 + 1, pairs_set)
    m = parts or best_parts(n, bits)
    groups = group_bits(np.array(together).reshape(64, 64), n, m)
    blocks = [[g[i : i + BLOCK] for i in range(0, len(g), BLOCK)] for g in groups]
    flat = [b for own in blocks for b in own]

    def values_seen(one: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(gather(one, b), minlength=1 << BLOCK) for b in flat])

    seen = _counted(fps, len(flat) << BLOCK, values_seen).reshape(len(flat), 1 << BLOCK)
    total = bits - m + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spheres = {(len(g), r): balls(len(g), r) for g in groups for r in range(bits + 1)}
        shares = {tuple(b): distances(seen[i, : 1 << len(b)], bits) for i, b in enumerate(flat)}
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                fps_ = whole.slice(start, 4096).column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                one = bit_matrix(fps_)
                cost = np.zeros((len(fps_), m, bits + 2))
                for i, own in enumerate(blocks):
                    near = np.zeros((len(fps_), bits + 1))  # estimated share of fingerprints at each distance in this part
                    near[:, 0] = 1
                    for b in own:
                        far = shares[tuple(b)][gather(one, b)]
                        near = np.stack([sum(near[:, j] * far[:, d - j] for j in range(d + 1)) for d in range(bits + 1)], 1)
                    cost[:, i, 1:] = np.cumsum(near, 1) * n + [len(spheres[len(groups[i]), r]) for r in range(bits + 1)]
                chosen = allocate(cost, total)
                for i, g in enumerate(groups):
                    value = gather(one, g) | i << 48
                    yield _rows(value, fps_, False)
                    for t in range(bits + 1):
                        at = np.flatnonzero(chosen[:, i] == t)
                        if len(at):
                            sphere = spheres[len(g), t]
                            yield _rows((value[at][:, None] ^ sphere).ravel(), np.repeat(fps_[at], len(sphere)), True)

    def _rows(key: np.ndarray, own: np.ndarray, probe: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": pa.array(key), "f": pa.array(own), "probe": pa.array(np.full(len(key), probe))})

    keyed = stored(fps.mapInArrow(run, "key long, f long, probe boolean"))
    probes = keyed.where("probe").select("key", F.col("f").alias("a"))
    index = keyed.where("!probe").select("key", F.col("f").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    found = probes.join(index, (probes.key == index.key) & (probes.a != index.b) & near)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, bits: int = 3, parts: int | None = None) -> DataFrame:
    """Add `fingerprint` (16 lowercase hex digits) and `component_id`, the least `key` of the group, to every row; `text` goes.

    One row per distinct fingerprint takes part in the search, however many rows share it.
    """
    rest = df.drop("fingerprint", "component_id", "fp", "root")
    fps = stored(fingerprints(rest, text, words))
    classes = stored(fps.groupBy("fp").agg(F.min(key).alias("least_key")))
    found = components(links(classes.select("fp"), bits, parts))
    joined = classes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = joined.groupBy("root").agg(F.min("least_key").alias("component_id"))
    named = joined.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0"))).drop("fp")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, bits: int = 3) -> DataFrame:
    """The rows of `df` whose `key` names its group: one document of each group of near-duplicates stays."""
    groups = near_duplicates(df.select(key, text), key, text, words, bits)
    first = groups.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_kept")).distinct()
    return df.join(first, F.col(key).eqNullSafe(F.col("_kept")), "left_semi")
