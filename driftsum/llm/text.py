"""Words and their 64-bit hashes, shared by the text operators.

A word is a maximal run of characters other than space and U+0009 to U+000D; on UTF-8 bytes
that is exactly what ``bytes.split()`` yields.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import xxhash

#: The pattern of a word, for Java and RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64
MULT = _U(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; all words as one run if there are fewer."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    k = min(size, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * MULT + hashes[i : n - k + 1 + i])
    return np.unique(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = np.multiply.accumulate(np.full(n - 1, base, np.uint64))
    return out[:n]


def window_hashes(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash of each run of exactly ``size`` words, by prefix sums modulo 2**64 (base must be odd)."""
    n = len(hashes)
    if n < size:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(base, n), out=sums[1:])
    inverse = powers(pow(base, -1, 1 << 64), n - size + 1)
    return mix((sums[size:] - sums[: n - size + 1]) * inverse)


def give_back() -> None:
    """Return freed memory to the system: Python workers wait for the next stage with all they have kept."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``rows``: Python objects exist for a few texts at a time only."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)
    give_back()
