"""Array kernels over batches of texts. A batch is one buffer of UTF-8 bytes and the offsets of its texts."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step of a kernel holds (a longer text is a step of its own); items that a kernel's scratch arrays hold, whatever the step.
STEP, BLOCK = 1 << 20, 1 << 18
WINDOW_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    col = column.cast(pa.large_binary()).fill_null(b"")
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def _released() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """run (over batches, a group or two cogroups), giving freed memory back to the system at its end.

    Python workers outlive their tasks; what an allocator holds back would add up over the stages.
    """
    if inspect.isgeneratorfunction(run):

        def over_batches(batches):
            try:
                yield from run(batches)
            finally:
                _released()

        return over_batches
    if len(inspect.signature(run).parameters) == 2:

        def over_pair(left, right):
            try:
                return run(left, right)
            finally:
                _released()

        return over_pair

    def over_group(table):
        try:
            return run(table)
        finally:
            _released()

    return over_group


def steps(offs: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, bounds) of words [^\\x20\\x09-\\x0D]+; bounds[i]:bounds[i+1] are the words of text i."""
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(data), BLOCK):
        hi = min(len(data), lo + BLOCK)
        solid = np.zeros(hi - lo + 2, bool)  # with a byte on either side
        a, b = max(lo - 1, 0), min(hi + 1, len(data))
        solid[a - lo + 1 : b - lo + 1] = ~SPACE[data[a:b]]
        cut = np.zeros(hi - lo + 1, bool)
        cut[offs[np.searchsorted(offs, lo) : np.searchsorted(offs, hi, "right")] - lo] = True
        starts.append(np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1])) + lo)
        ends.append(np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + lo + 1)
    start = np.concatenate(starts)
    return start, np.concatenate(ends), np.searchsorted(start, offs)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end], by polynomials over blocks of bytes; seeds give independent ones."""
    out, base = np.empty(len(start), np.uint64), WORD_BASE + 2 * seed
    salt = np.uint64((seed * 0xA0761D6478BD642F) & (2**64 - 1))  # a word of one byte has no power of the base in it
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
        lo, hi = start[i], end[j - 1]
        up = powers(base, hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        down = powers(inverse(base), hi - lo)
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix(((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(WINDOW_BASE)) ^ salt)
        i = j
    return out


def window_hashes(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of every run of size items of h (hashes themselves), mixed."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, out = WINDOW_BASE + 2 * seed, np.empty(n, np.uint64)
    up, down = powers(base, min(len(h), BLOCK + size - 1)), powers(inverse(base), min(n, BLOCK))
    for i in range(0, n, BLOCK):
        part = h[i : i + BLOCK + size - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        here = len(part) - size + 1
        out[i : i + here] = mix((sums[size:] - sums[:here]) * down[:here] + np.uint64(size))
    return out


def inside(bounds: np.ndarray, size: int) -> np.ndarray:
    """For windows over texts laid end to end: which start where a whole window fits into its text."""
    total = int(bounds[-1])
    ok = np.ones(max(0, total - size + 1), bool)
    last = np.maximum(bounds[1:] - size + 1, bounds[:-1])  # the first start that doesn't fit
    for a, b in zip(last.tolist(), bounds[1:].tolist(), strict=True):
        ok[a:b] = False
    return ok


def covered(flags: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n items lie in a flagged window of size items."""
    step = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(flags)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return np.cumsum(step[:-1]) > 0


def runs(flags: np.ndarray) -> np.ndarray:
    """[start, end) of the maximal runs of True, one a row."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge.reshape(-1, 2)
