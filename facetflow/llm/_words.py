"""Vectorised words and shingles of Arrow batches.

A word is a run of bytes other than space and 0x09-0x0D, so the words of a UTF-8 text are those of the pattern
``[^\\x20\\x09-\\x0D]+``. Hashes are 64 bit, depend on the (A-Z lower-cased) bytes alone and are the same in every
task. Texts are handled in blocks of about ``BLOCK`` bytes, so memory does not grow with a batch; one longer text is
a block of its own.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
# what Arrow frees goes back to the system at once, as several workers share an executor's memory
pa.set_memory_pool(pa.system_memory_pool())
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_powers: dict[str, np.ndarray] = {}


def trimmed(run: Callable) -> Callable:
    """``run`` over batches, after which the worker gives the memory of the task back to the system."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * BLOCK:
            _powers[key] = have
    return have[:n]


class Words:
    """Words of a block of texts: ``start``/``end`` are byte places in ``data``, ``first[i]:first[i + 1]`` the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        inner = offsets[(offsets > 0) & (offsets < n)]
        begins[inner] = inside[inner]
        ends = np.zeros(n, bool)
        if n:
            ends[:-1] = inside[:-1] & ~inside[1:]
            ends[-1] = inside[-1]
            ends[inner - 1] |= inside[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[self.data] * _power(_BASE, n), out=total[1:])
        return mix((total[self.end] - total[self.start]) * _power(_INVERSE, n + 1)[self.start] + (self.end - self.start).astype(np.uint64))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 places run past the end of the array."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _U(0xD6E8FEB86659FD93)
        out += hashes[j : n + j]
    return mix(out)


def run_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` values from each one on, for whole numbers."""
    n = len(values)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(values.astype(np.uint64)) * _power(_BASE, n), out=total[1:])
    return mix((total[size:] - total[: n - size + 1]) * _power(_INVERSE, n)[: n - size + 1])


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins; nulls are empty."""
    if pa.types.is_dictionary(texts.type):
        texts = texts.dictionary_decode()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64, len(texts) + 1, texts.offset * 8) if at else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) of consecutive texts of about BLOCK bytes."""
    data, offsets = as_bytes(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
