"""Numbers of many rows as bits, each row's in whole bytes of its own; all rows of a batch at once."""

from __future__ import annotations

import numpy as np


def within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each row of n values."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _starts(bits: np.ndarray) -> np.ndarray:
    """Bytes before each row and after the last one, for rows of so many bits."""
    return np.concatenate([[0], np.cumsum((bits + 7) // 8)])


def unary(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): as many zeros as a value says, then a one. Rows have n values each, of 0 or more."""
    ends = np.concatenate([[0], np.cumsum(values + 1)])
    rows = np.concatenate([[0], np.cumsum(n)])
    before = ends[rows]
    starts = _starts(np.diff(before))
    bits = np.zeros(8 * starts[-1], np.uint8)
    bits[ends[1:] - 1 + np.repeat(8 * starts[:-1] - before[:-1], n)] = 1
    return np.packbits(bits), starts


def from_unary(data: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    ones = np.flatnonzero(np.unpackbits(data))
    first = within(n) == 0
    left = np.concatenate([[0], ones[:-1] + 1])[: len(ones)]
    left[first] = np.repeat(8 * starts[:-1], n)[first]
    return ones - left


def fixed(values: np.ndarray, width: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): the low bits of each value, as many as its row's width, lowest first."""
    starts = _starts(n * width)
    bits, w = np.zeros(8 * starts[-1], np.uint8), np.repeat(width, n)
    place = 8 * np.repeat(starts[:-1], n) + within(n) * w
    for j in range(int(width.max(initial=0))):
        on = w > j
        bits[place[on] + j] = values[on] >> j & 1
    return np.packbits(bits), starts


def from_fixed(data: np.ndarray, starts: np.ndarray, width: np.ndarray, n: np.ndarray) -> np.ndarray:
    bits, w = np.unpackbits(data), np.repeat(width, n)
    place = 8 * np.repeat(starts[:-1], n) + within(n) * w
    out = np.zeros(len(w), np.int64)
    for j in range(int(width.max(initial=0))):
        on = w > j
        out[on] |= bits[place[on] + j].astype(np.int64) << j
    return out
