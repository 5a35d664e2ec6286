"""Vectorised scans of Arrow string columns: words, lines and their hashes, over whole batches.

A batch is cut at document boundaries into slices of about ``SLICE`` bytes (a longer document
is a slice of its own), and every function works on one slice's UTF-8 bytes at once.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
#: \x20 and \x09-\x0D
IS_WS = np.zeros(256, bool)
IS_WS[[0x20, *range(0x09, 0x0E)]] = True
#: bytes that start a code point
IS_START = (np.arange(256) & 0xC0) != 0x80


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """f for mapInArrow, with what its worker has freed given back to the system at its end.

    Workers are reused by later stages, whose memory would otherwise come on top; powers that a
    text longer than a slice has called for are forgotten too.
    """

    def g(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return g


def give_back() -> None:
    """By a function of the module, as a nested one would be sent with copies of the module's values."""
    _POWERS.shrink()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def held_powers() -> int:
    return len(_POWERS.up)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(33))
    h = h * _MIX1
    h = h ^ (h >> U64(33))
    h = h * _MIX2
    return h ^ (h >> U64(33))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _BASE)


@dataclass
class Slice:
    first: int  # of the batch's rows
    buf: np.ndarray  # uint8
    ends: np.ndarray  # byte offsets, one more than documents


def strings(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of the column, nulls as empty strings, 64-bit offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    return col.cast(pa.large_string()).fill_null("")


def slices(col: pa.Array) -> Iterator[Slice]:
    """col: from strings()."""
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + SLICE, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield Slice(i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


class Powers:
    """base^i and base^-i modulo 2^64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = U64(pow(int(_BASE), -1, 1 << 64))
            self.up = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, _BASE, U64)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, inverse, U64)]))
        return self.up, self.down

    def shrink(self) -> None:
        """Forget what only a text longer than a slice needs."""
        if len(self.up) > 2 * SLICE:
            self.up = self.down = np.ones(1, U64)


_POWERS = Powers()


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever they stand."""
    up, down = _POWERS.get(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


def word_spans(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word, in order."""
    word = ~IS_WS[s.buf]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[:1] = False
    inner = s.ends[:-1][s.ends[:-1] < len(word)]
    before[inner] = False
    start = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[:-1] = word[1:]
    after[-1:] = False
    after[s.ends[1:][s.ends[1:] > 0] - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(s.ends, start, side="right") - 1


def line_spans(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every \\n-separated line, a document without one being a line."""
    nl = np.flatnonzero(s.buf == 10)
    doc = np.searchsorted(s.ends, nl, side="right") - 1
    start = np.concatenate([s.ends[:-1], nl + 1])
    end = np.concatenate([nl, s.ends[1:]])
    docs = np.arange(len(s.ends) - 1)
    of_start, of_end = np.concatenate([docs, doc]), np.concatenate([doc, docs])
    a, b = np.lexsort((start, of_start)), np.lexsort((end, of_end))
    return start[a], end[b], of_start[a]


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of values between each two successive ends."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[ends])


def windows(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of k words inside one document."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    h = np.zeros(len(at), U64)
    for j in range(k):
        h = h * _BASE + hashes[at + j]
    return mix(h), at
