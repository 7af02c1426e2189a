"""NumPy over a block of texts at once: words, word hashes, rolling hashes, window minima.

A block is the UTF-8 bytes of several documents without separators plus their offsets, as
Arrow holds them. Hashes are polynomials modulo 2**64 over a table of mixed byte values,
taken from prefix sums and then mixed; equal strings give equal hashes in every task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply rounds)."""
    y = x >> U(30)
    y ^= x
    y *= U(0xBF58476D1CE4E5B9)
    y ^= y >> U(27)
    y *= U(0x94D049BB133111EB)
    y ^= y >> U(31)
    return y


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        p = np.full(size, base, U)
        p[0] = 1
        have = _powers[base] = np.cumprod(p, dtype=U)
    return have[:n]


class Prefix:
    """Prefix sums from which the hash of any span is read."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * _power(_BASE, n), out=self.sums[1:], dtype=U)
        self.inverse = _power(_INVERSE, n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U))

    def rolling(self, k: int) -> np.ndarray:
        """Hash of every k consecutive values."""
        if len(self.sums) <= k:
            return np.empty(0, U)
        d = self.sums[k:] - self.sums[:-k]
        d *= self.inverse[:len(d)]
        d += U(k)
        return mix(d)


def block(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array without nulls."""
    n = len(text)
    off = np.frombuffer(text.buffers()[1], np.int64, count=n + 1, offset=8 * text.offset)
    buf = text.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0]:off[-1]] if buf is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each document's first word (one more at the end)."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    gap = SPACE[data]
    full = off[:-1][off[1:] > off[:-1]]
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1]
    first[full] = ~gap[full]
    stop = off[1:][off[1:] > off[:-1]] - 1
    last[:-1] &= gap[1:]
    last[stop] = ~gap[stop]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def byte_prefix(data: np.ndarray) -> Prefix:
    return Prefix(_BYTE[data])


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return byte_prefix(data).spans(start, end)


_PLACE = 24


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost least of each w consecutive values, by their high 40 bits. The place
    rides in the low bits, so long arrays are taken in stretches; equal windows get the same place."""
    n, low, step = len(values) - w + 1, U((1 << _PLACE) - 1), (1 << _PLACE) - w
    out = np.empty(max(n, 0), np.int64)
    for at in range(0, n, step):
        part = values[at:at + step + w - 1]
        best, span = (part & ~low) | np.arange(len(part), dtype=U), 1
        while span * 2 <= w:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        if span < w:
            best = np.minimum(best[:span - w], best[w - span:])
        out[at:at + step] = (best & low).astype(np.int64) + at
    return out


def inside(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """True where k consecutive items from a position stay in its document; first: document bounds."""
    ok = np.zeros(max(0, n - k + 1), bool)
    step = np.zeros(n + 2, np.int64)
    begin, end = first[:-1], first[1:] - k + 1
    good = end > begin
    np.add.at(step, begin[good], 1)
    np.add.at(step, end[good], -1)
    if len(ok):
        ok[:] = np.cumsum(step[:len(ok)]) > 0
    return ok
