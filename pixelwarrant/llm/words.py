"""Words of whole Arrow columns of texts, found on bytes at once: codes, places and 64-bit keys.

The separators are ASCII, so bytes of UTF-8 are cut as characters would be. A null text has no words.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4_000_000  # of text that is worked on at once; a longer text is a chunk of its own
SEED = 42


def kinds(blanks: bytes, breaks: bytes = b"") -> np.ndarray:
    """For each byte: 0 in a word, 1 between words, 2 between pieces."""
    out = np.zeros(256, np.uint8)
    out[np.frombuffer(blanks, np.uint8)] = 1
    out[np.frombuffer(breaks, np.uint8)] = 2
    return out


#: Words are runs of anything but these.
PLAIN = kinds(bytes([0x20, *range(0x09, 0x0E)]))


@dataclass
class Words:
    codes: np.ndarray  # of every word: its place in `distinct`
    distinct: pa.Array  # the different words, as bytes
    doc: np.ndarray  # of every word: its row
    piece: np.ndarray  # of every word: grows by at least one at every break and row
    counts: np.ndarray  # words of each row

    def starts(self) -> np.ndarray:
        """The first word of each row, and the end."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    def keys(self, seed: int = SEED) -> np.ndarray:
        """An XXH64 of every different word."""
        from xxhash import xxh64_digest

        raw = b"".join([xxh64_digest(w, seed) for w in self.distinct.to_pylist()])
        return np.frombuffer(raw, ">u8").astype(np.uint64)


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` whose texts of `column` hold about CHUNK_BYTES at most."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + CHUNK_BYTES, "right"))
        end = max(end, start + 1)
        yield batch.slice(start, end - start)
        start = end


def words(texts: pa.Array, kind: np.ndarray = PLAIN, lower: bool = False) -> Words:
    """The words of a column of strings or bytes; `lower` turns A-Z into a-z."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    of = kind[raw]
    inside = of == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    held = raw[inside]
    if lower:
        held = held + (((held >= 65) & (held <= 90)) * np.uint8(32))
    places = np.empty(len(starts) + 1, np.int64)
    size = np.int32 if len(raw) < 1 << 31 else np.int64
    places[:-1] = np.cumsum(inside, dtype=size)[starts] - 1
    places[-1] = len(held)
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(held))])
    coded = kept.dictionary_encode()
    doc = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(of == 2, dtype=size)[starts] + doc if (of == 2).any() else doc
    counts = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, doc, piece, counts)
