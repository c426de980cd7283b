"""Vectorised text kernels over Arrow string buffers: word spans and 64-bit word hashes.

Everything works on UTF-8 bytes; separators and case folding are ASCII, so bytes of longer
code points pass through unchanged. Batches are cut to about CHUNK bytes to bound memory: a kernel
needs some fifty bytes for each byte of text, and a waiting worker keeps much of what it once took.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        both = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            both.append(np.cumprod(step, dtype=np.uint64))
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `size` bytes of text each, and at most `rows` rows; a longer text has a slice of its own."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        stop = min(stop, start + rows) if rows else stop
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()  # workers wait for later stages with what they keep


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets into them; null counts as empty."""
    arr = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(arr) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def lut(separators: list[int] | range) -> np.ndarray:
    """True for bytes that belong to words."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


SPACES = lut([0x20, *range(0x09, 0x0E)])


def words(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 values)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    w = word_byte[data]
    before, after = np.empty_like(w), np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    after[-1], after[:-1] = False, w[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = FOLD) -> np.ndarray:
    """A mixed 64-bit polynomial hash of each span, independent of its place."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[fold][data] * up[:-1], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each `width` consecutive values, in order; the caller leaves out runs over two texts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        total += hashes[j : j + n] * _STEP[j]
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5, word_byte: np.ndarray = SPACES) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles; a text of fewer words is one shingle, one without words none."""
    starts, ends, first = words(data, offsets, word_byte)
    hashes = span_hashes(data, starts, ends)
    runs = run_hashes(hashes, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            found = np.sort(runs[a : b - width + 1])
            keep = np.empty(len(found), dtype=bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found if keep.all() else found[keep]
        elif b > a:
            yield run_hashes(hashes[a:b], b - a)
        else:
            yield np.empty(0, np.uint64)
