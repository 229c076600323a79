"""Vectorised word and window hashes over UTF-8 bytes (numpy, inside Spark tasks)."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_STEP = U(0xD1B54A32D192ED03)

#: Bytes that end a word: space and \x09-\x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_IN_WORD = (~WHITE).view(np.int8)
#: Masks that keep the first 0 to 8 of eight bytes.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)

_powers = np.ones(1, U)
_inverse = np.ones(1, U)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) <= n:
        size = max(n + 1, 1 << 16)
        back = U(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[U(1), np.full(size, _BASE, U)])
            _inverse = np.cumprod(np.r_[U(1), np.full(size, back, U)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, near ones spread."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def lanes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces of ``data`` (first byte, bytes), eight bytes at a time."""
    padded = np.empty(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    padded[len(data) :] = 0
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    with np.errstate(over="ignore"):
        out = mix(size.astype(U) * _BASE ^ eight[start] & _KEEP[np.minimum(size, 8)])
        more = np.flatnonzero(size > 8)
        at = 8
        while len(more):
            out[more] = mix(out[more] * _STEP ^ eight[start[more] + at] & _KEEP[np.minimum(size[more] - at, 8)])
            at += 8
            more = more[size[more] > at]
    return out


class Words:
    """Words of a run of texts: ``start``, ``end`` (bytes), ``doc`` (index of the text), ``hash`` (64 bits)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        data = LOWER[data] if lower else data
        word = np.zeros(len(data) + 2, np.int8)
        np.take(_IN_WORD, data, out=word[1:-1])
        edge = np.diff(word)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # a word never crosses the border of two texts
        inner = np.unique(offsets[1:-1])
        inner = inner[(inner > 0) & (inner < len(data))]
        inner = inner[(word[inner] > 0) & (word[inner + 1] > 0)]
        if len(inner):
            self.start, self.end = np.sort(np.r_[self.start, inner]), np.sort(np.r_[self.end, inner])
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.hash = lanes(data, self.start, self.end - self.start)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive symbols; the result is ``size`` - 1 shorter."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * _STEP + hashes[j : j + n]
    return mix(out)


def lowest_right(values: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` consecutive values, the index of its smallest one, of equal ones the last."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, span = values.copy(), np.arange(len(values)), 1
    while span < size:
        step = min(span, size - span)
        right = best[step:] <= best[:-step]
        at = np.where(right, at[step:], at[:-step])
        best = np.where(right, best[step:], best[:-step])
        span += step
    return at
