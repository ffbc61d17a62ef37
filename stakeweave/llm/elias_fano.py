"""Elias-Fano sequences whose look-ups work on whole arrays of queries."""

from __future__ import annotations

import numpy as np

_SAMPLE = 32
#: Place of the k-th set bit in each byte value, 8 where there is none.
_PLACE = np.full((256, 8), 8, np.uint8)
for _value in range(256):
    for _k, _bit in enumerate(b for b in range(8) if _value >> b & 1):
        _PLACE[_value, _k] = _bit
_BITS = np.array([bin(v).count("1") for v in range(256)], np.uint8)


def _select(words: np.ndarray, samples: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
    """Places of the k-th set bits (from 0) of a bit vector; of its clear bits if ``flip``."""
    at = samples[k // _SAMPLE].astype(np.int64)
    word = at >> 6
    # Bits before the sampled one in its word are taken off; what is left to pass is k mod _SAMPLE.
    value = words[word]
    value = (~value if flip else value) & (np.uint64(0xFFFFFFFFFFFFFFFF) << (at & 63).astype(np.uint64))
    left = (k % _SAMPLE).astype(np.int64)
    count = np.bitwise_count(value).astype(np.int64)
    todo = np.flatnonzero(left >= count)
    while len(todo):
        left[todo] -= count[todo]
        word[todo] += 1
        v = words[word[todo]]
        value[todo] = ~v if flip else v
        count[todo] = np.bitwise_count(value[todo])
        todo = todo[left[todo] >= count[todo]]
    place = word << 6
    for half in (32, 16, 8):
        low = value & np.uint64((1 << half) - 1)
        n = np.bitwise_count(low).astype(np.int64)
        skip = left >= n
        left = np.where(skip, left - n, left)
        place = np.where(skip, place + half, place)
        value = np.where(skip, value >> np.uint64(half), low)
    return place + _PLACE[value.astype(np.int64), left]


class EliasFano:
    """A strictly ascending or repeating monotone sequence of whole numbers."""

    PARTS = ("meta", "low", "high", "ones", "zeros")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.width, self.top = (int(x) for x in parts["meta"])
        self.low, self.high, self.ones, self.zeros = (parts[p] for p in self.PARTS[1:])

    @classmethod
    def build(cls, values: np.ndarray) -> dict[str, np.ndarray]:
        """Arrays of the sequence, to be stored and given to the constructor."""
        v = np.asarray(values, np.int64)
        n = len(v)
        top = int(v[-1]) if n else 0
        width = max(0, int(np.log2((top + 1) / n))) if n and top + 1 > n else 0
        place = (v >> width) + np.arange(n)
        size = (top >> width) + n + 1
        bits = np.zeros(-(-(size + 1) // 64) * 64 + 64, np.uint8)
        bits[place] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        low_bits = np.zeros(n * width + 128, np.uint8)
        for b in range(width):
            low_bits[np.arange(n) * width + b] = v >> b & 1
        low_bits = np.concatenate([low_bits, np.zeros(-len(low_bits) % 64, np.uint8)])
        low = np.packbits(low_bits, bitorder="little").view(np.uint64)
        zeros = np.flatnonzero(bits == 0)[::_SAMPLE]
        return {
            "meta": np.array([n, width, top >> width], np.int64), "low": low, "high": high,
            "ones": place[::_SAMPLE].astype(np.int64), "zeros": zeros.astype(np.int64),
        }

    def _lower(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> shift
        spill = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((value | spill) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        if not len(i):
            return np.zeros(0, np.int64)
        return ((_select(self.high, self.ones, i, False) - i) << self.width) | self._lower(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each value of ``x``, or -1: the successor search, kept where it is exact."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        rows = np.flatnonzero((x >= 0) & ((x >> self.width) <= self.top))
        if not len(rows):
            return out
        want = x[rows]
        head = want >> self.width
        # Values with this upper part lie behind the clear bit that ends the one before.
        begin = np.where(head > 0, _select(self.high, self.zeros, np.maximum(head - 1, 0), True) - np.maximum(head - 1, 0), 0)
        end = _select(self.high, self.zeros, head, True) - head
        lower = want & ((1 << self.width) - 1)
        # Halve [begin, end) until one value is left; most hold one or two.
        lo, hi = begin, end
        todo = np.flatnonzero(hi - lo > 1)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            right = self._lower(mid) <= lower[todo]
            lo[todo] = np.where(right, mid, lo[todo])
            hi[todo] = np.where(right, hi[todo], mid)
            todo = todo[hi[todo] - lo[todo] > 1]
        ok = end > begin
        ok[ok] = self._lower(lo[ok]) == lower[ok]
        out[rows[ok]] = lo[ok]
        return out
