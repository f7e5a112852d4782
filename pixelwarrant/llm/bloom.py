"""Bloom filters of rows of longs: bounded in size, so they can be broadcast whatever a table holds.

What passes by chance has to be harmless to whoever asks; nothing that was put in is ever refused.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS = 1 << 20
MOST_BITS = 1 << 27  # 16 MB
EACH = 16  # bits a row, until MOST_BITS are used up


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit number of each row."""
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        out = (out ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _places(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two of `size` bits for each number; `size` is a power of two."""
    low = np.uint64(size - 1)
    return numbers & low, (numbers >> np.uint64(29)) & low


def build(rows: DataFrame, names: list[str]) -> np.ndarray:
    """The filter of the columns `names`; its 64-bit words are or-ed in a grouped job and read by the driver, 32 MB at most."""
    size, count = LEAST_BITS, rows.count()
    while size < min(EACH * count, MOST_BITS):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_places(mixed([c.to_numpy(zero_copy_only=False) for c in batch.columns]), size))
            bits = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bits)], ["place", "bits"])

    words = rows.select(*names).mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[words["place"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def passes(filter: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Which rows may be in the filter."""
    one, two = _places(mixed(columns), len(filter) << 6)
    held = lambda at: (filter[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
    return (held(one) & held(two)).astype(bool)
