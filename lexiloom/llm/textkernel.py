"""Words and hashes of many texts at once, on the bytes of an Arrow string column.

Texts are never copied into Python strings. Work goes by pieces of about PIECE
bytes, cut between words, so that memory does not grow with a text, however long.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LEN = np.uint64(0xD6E8FEB86659FD93)

#: A-Z lowered, and one added, so that no byte counts as nothing.
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_powers: list[np.ndarray] = []


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Words are runs of anything but space, tab, LF, VT, FF and CR.
SPACES = separators((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of ASCII letters, digits and bytes over 0x7F; of use after lowering A-Z.
NON_ALNUM = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers, n at least, of an odd base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            both.append(np.cumprod(a, dtype=np.uint64))
        _powers[:] = both
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (one more for the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    dtype = np.int64 if wide else np.int32
    bounds = np.zeros(1, np.int64) if offsets is None or not len(column) else np.frombuffer(offsets, dtype=dtype)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_spans(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; words never cross from one text into the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~table[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = bounds[(bounds > 0) & (bounds < len(data))]
    begins[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cut - 1] = inside[cut - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _cuts(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + PIECE, n)
        if hi < n:
            k = bounds[np.searchsorted(bounds, hi, "right") - 1]
            if k > lo:
                hi = int(k)
            else:  # one long text: up to the last separator, or the next one or the text's end
                last = np.flatnonzero(table[data[lo:hi]])
                if len(last):
                    hi = lo + int(last[-1]) + 1
                else:
                    end = int(bounds[np.searchsorted(bounds, hi, "left")])
                    while hi < end:
                        found = np.flatnonzero(table[data[hi : min(hi + PIECE, end)]])
                        if len(found):
                            hi += int(found[0]) + 1
                            break
                        hi = min(hi + PIECE, end)
        yield lo, hi
        lo = hi


def hash_words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all words, in order: a 64-bit hash of the word with A-Z lowered, its start and end; and for each text its first word (one more for the end)."""
    hashes, starts, ends = [], [], []
    for lo, hi in _cuts(data, bounds, table):
        part = data[lo:hi]
        a, b = np.searchsorted(bounds, [lo, hi])
        s, e = word_spans(part, bounds[a : b + 1] - lo, table)
        if not len(s):
            continue
        up, down = powers(hi - lo)
        terms = _LOWER[part] * up[: hi - lo]
        sums = np.cumsum(terms, dtype=np.uint64)
        h = (sums[e - 1] - sums[s] + terms[s]) * down[s]
        hashes.append(mix(h + (e - s).astype(np.uint64) * _LEN))
        starts.append(s + lo)
        ends.append(e + lo)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(bounds), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, bounds)


def chain(words: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Hashes of ``length`` words from each of the positions ``first`` on."""
    total = np.full(len(first), length, dtype=np.uint64) * _LEN
    for j in range(length):
        total = (total + words[first + j]) * np.uint64(_BASE)
    return mix(total)


def text_slices(bounds: np.ndarray, limit: int = 2 * PIECE) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``limit`` bytes; at least one text each."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def lean(run):
    """``run`` over Arrow batches, after which the worker gives back what memory it holds.

    Workers are kept for later tasks; without this, each would hold the most it ever
    needed while the JVM beside it does other work.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped
