"""Word shingles of whole texts as 64-bit hashes, a batch of documents at a time, in numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_ODD = _RNG.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Keeps the powers of the polynomial base between batches; one a worker is enough."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word of the texts, and the number of words before each text (one more at the end)."""
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        gap = np.empty(len(data) + 2, bool)
        gap[0] = gap[-1] = True
        np.take(_GAP, data, out=gap[1:-1])
        begin = np.flatnonzero(gap[:-1] & ~gap[1:])
        end = np.flatnonzero(~gap[:-1] & gap[1:])
        value, at = np.empty(len(begin), np.uint64), 0
        while at < len(begin):  # a megabyte at a time, more only for a longer word
            low = begin[at]
            to = max(at + 1, int(np.searchsorted(end, low + 1_000_000, "right")))
            value[at:to] = self._values(data[low : end[to - 1]], begin[at:to] - low, end[at:to] - low)
            at = to
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return mix(value), np.searchsorted(begin, starts)

    def _values(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.up) < len(data) + 1:
            self.up, self.down = powers(_BASE, len(data) + 1), powers(_BASE_INVERSE, len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data]] * self.up[: len(data)], out=total[1:])
        return (total[end] - total[begin]) * self.down[begin] + (end - begin).astype(np.uint64)

    def sets(self, texts: list[bytes], size: int):
        """For each text the sorted distinct hashes of its shingles of size words; with fewer words, of them all."""
        word, first = self.words(texts)
        n = max(0, len(word) - size + 1)
        rolled = np.zeros(n, np.uint64)
        for i in range(size):
            rolled += word[i : i + n] * _ODD[i]
        rolled = mix(rolled)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                short = word[a:b] * _ODD[: b - a]
                yield mix(short.sum(dtype=np.uint64, keepdims=True) + _ODD[32 + b - a])
            else:
                yield np.zeros(0, np.uint64)
