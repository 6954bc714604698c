"""Elias-Fano coding of non-decreasing numbers, with vectorised access and search."""

from __future__ import annotations

import numpy as np

_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: _NTH[b, k]: place of the k-th (from 0) set bit of byte b.
_NTH = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)
_SHIFTS = np.arange(64, dtype=np.uint64)


class EliasFano:
    """Numbers below ``universe`` in about 2 + log2(universe / n) bits each.

    ``low`` bits of every number lie side by side; the rest is a bit string with a one per number, in which the k-th number's one
    has as many zeros before it as its high part says. Arrays may be views of a memory map.
    """

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray):
        self.n, self.low, self.lows, self.highs = n, low, lows, highs
        ones = _ONES[highs].astype(np.int64)
        self.ones_before = np.concatenate(([0], np.cumsum(ones)))
        self.zeros_before = 8 * np.arange(len(highs) + 1) - self.ones_before

    @staticmethod
    def encode(values: np.ndarray, universe: int, align: int = 1) -> bytes:
        """``align`` 8 rounds the low bits up to whole bytes: a little longer, several times faster to write."""
        n = len(values)
        low = max(0, int(universe // max(n, 1)).bit_length() - 1)
        low = -(-low // align) * align
        values = values.astype("<u8")
        if low % 8 == 0:
            lows = np.ascontiguousarray(values.view(np.uint8).reshape(n, 8)[:, :low // 8]).ravel()
        else:
            lows = np.packbits(((values[:, None] >> _SHIFTS[:low]) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros((universe >> low) + n + 1, np.uint8)
        high[ones] = 1
        highs = np.packbits(high, bitorder="little")
        return np.array([n, low, len(lows), len(highs)], "<i8").tobytes() + lows.tobytes() + bytes(8) + highs.tobytes()

    @staticmethod
    def view(data: np.ndarray, at: int = 0) -> EliasFano:
        """Over bytes that ``encode`` wrote, from position ``at``; nothing is copied."""
        n, low, a, b = (int(x) for x in np.frombuffer(data[at:at + 32].tobytes(), "<i8"))
        return EliasFano(n, low, data[at + 32:at + 40 + a], data[at + 40 + a:at + 40 + a + b])

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.int64)
        bit = i * self.low
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        word = np.zeros(len(i), np.uint64)
        for k in range((self.low + 14) // 8):
            word |= self.lows[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return ((word >> shift) & np.uint64((1 << self.low) - 1)).astype(np.int64)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[:self.n]
        return ((ones - np.arange(self.n)) << self.low) | self._lows(np.arange(self.n))

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        byte = np.searchsorted(self.ones_before, i, "right") - 1
        one = 8 * byte + _NTH[self.highs[byte], i - self.ones_before[byte]]
        return ((one - i) << self.low) | self._lows(i)

    def _bucket(self, high: np.ndarray) -> np.ndarray:
        """Place of the first number whose high part is at least ``high``: behind the high-th zero."""
        zero = high - 1
        byte = np.searchsorted(self.zeros_before, np.maximum(zero, 0), "right") - 1
        place = 8 * byte + _NTH[255 - self.highs[np.minimum(byte, len(self.highs) - 1)], np.maximum(zero, 0) - self.zeros_before[byte]]
        return np.where(high > 0, place + 1 - high, 0)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each number of ``x``, or -1: successor search in the numbers that share its high part."""
        if not self.n:
            return np.full(len(x), -1)
        high = x >> self.low
        inside = high < 8 * len(self.highs) - self.n
        place = np.where(inside, self._bucket(np.where(inside, high, 0)), self.n)
        ends = np.where(inside, self._bucket(np.where(inside, high + 1, 0)), self.n)
        out = np.full(len(x), -1)
        want = x & ((1 << self.low) - 1)
        todo = np.flatnonzero(place < ends)
        while len(todo):  # halve the stretch of numbers with this high part
            mid = (place[todo] + ends[todo]) >> 1
            there = self._lows(mid)
            hit = there == want[todo]
            out[todo[hit]] = mid[hit]
            right = there < want[todo]
            place[todo[right]] = mid[right] + 1
            ends[todo[~right]] = mid[~right]
            todo = todo[~hit & (place[todo] < ends[todo])]
        return out
