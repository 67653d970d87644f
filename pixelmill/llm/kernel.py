"""Array kernels over blocks of texts: slicing Arrow batches, finding words, hashing words and shingles.

A block is the concatenated UTF-8 of some rows with their byte offsets, so one numpy call handles thousands of
rows and no per-row Python object is made. Words are maximal runs of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_R = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i] = x
        x = x * base & _MASK
    return out


_STEP = 1 << 12
_LO, _HI_BASE = _powers(_R, _STEP), pow(_R, _STEP, 1 << 64)
_INV_LO, _INV_BASE = _powers(pow(_R, -1, 1 << 64), _STEP), pow(pow(_R, -1, 1 << 64), _STEP, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes: (first row, end row, offsets from 0, bytes). A null text is empty.

    A text longer than ``limit`` is a slice of its own, whole.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and at[-1] else np.zeros(0, np.uint8)
    row, n = 0, len(texts)
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, at[row : end + 1] - at[row], data[at[row] : at[end]]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each row's first word (one more entry than rows)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    black = ~_SPACE[data]
    begins = black.copy()
    begins[1:] &= ~black[:-1]
    ends = black.copy()
    ends[:-1] &= ~black[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = black[inner]
    ends[inner - 1] = black[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by prefix sums of a polynomial with random byte values."""
    n = len(data)
    rows = n // _STEP + 1
    power = (_powers(_HI_BASE, rows)[:, None] * _LO[None, :]).ravel()[:n]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power, out=sums[1:])
    back = _powers(_INV_BASE, rows)[starts // _STEP] * _INV_LO[starts % _STEP]
    return mix((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64))


_GRAM = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def grams(words: np.ndarray, first: np.ndarray, size: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each row's windows of ``size`` words: (hashes, each row's first window, first word of each window).

    A row of fewer words, one at least, gives one hash of them all if ``whole_if_short``.
    """
    count = np.diff(first)
    n_windows = np.maximum(count - size + 1, 0)
    n_out = np.where(whole_if_short & (n_windows == 0) & (count > 0), 1, n_windows)
    at = np.zeros(len(first), np.int64)
    np.cumsum(n_out, out=at[1:])
    word = np.repeat(first[:-1] - at[:-1], n_out) + np.arange(at[-1])
    out = np.full(int(at[-1]), size, np.uint64)
    for k in range(size):
        i = word + k
        if k:
            short = np.repeat(count, n_out) <= k
            i = np.minimum(i, max(len(words) - 1, 0))
            out += np.where(short, np.uint64(0x1234567), words[i] * _GRAM[k]) if len(words) else np.uint64(0)
        elif len(words):
            out += words[i] * _GRAM[0]
    return mix(out), at, word


def sorted_sets(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in ascending order, and where each row begins."""
    out = hashes.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    if len(out):
        keep[1:] = out[1:] != out[:-1]
        keep[at[:-1][at[:-1] < len(out)]] = True
    total = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return out[keep], total[at]


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of consecutive ranges, empty ones 0; integers exactly (unsigned modulo 2**64), floats by range, whatever stands beside it."""
    if values.dtype.kind == "f":
        out, some = np.zeros(len(at) - 1), at[1:] > at[:-1]
        if some.any():
            out[some] = np.add.reduceat(values[: at[-1]].astype(np.float64), at[:-1][some])
        return out
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "u" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of lower-cased (A-Z) texts as sorted hashes by row."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets)
    words = span_hash(low, starts, ends)
    hashes, at, _ = grams(words, first, size)
    return sorted_sets(hashes, at)


def give_back() -> None:
    """Returns freed memory to the system: a worker outlives its tasks, and what allocators keep would add up."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc's
        trim(0)


def tidied(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for mapInArrow, with :func:`give_back` at the partition's end."""

    def tidy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def replace_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    k = batch.schema.get_field_index(name)
    return batch.set_column(k, batch.schema.field(k).name, values)
