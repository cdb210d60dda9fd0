"""Bit vectors and wavelet matrices over numpy arrays: every query takes an array of positions."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits packed in 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray | None = None, *, packed: np.ndarray | None = None, size: int = 0):
        self.size = size if bits is None else len(bits)
        raw = np.packbits(bits, bitorder="little") if packed is None else packed
        words = np.zeros(self.size // 64 * 8 + 8, np.uint8)
        words[: len(raw)] = raw
        self.words = words.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def packed(self) -> bytes:
        return self.words.view(np.uint8)[: (self.size + 7) // 8].tobytes()

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.size, bitorder="little").view(bool)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones in [0, i)."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)

    def select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) bit of that value."""
        own = np.arange(len(self.before)) * 64 - self.before if not bit else self.before
        w = np.searchsorted(own, k, side="right") - 1
        rest, word = k - own[w], self.words[w] if bit else ~self.words[w]
        at = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(word >> at.astype(np.uint64) & np.uint64((1 << width) - 1)).astype(np.int64)
            over = rest >= ones
            rest -= np.where(over, ones, 0)
            at += np.where(over, width, 0)
        return w * 64 + at


class WaveletMatrix:
    """Values below 2**width as bit planes, highest first; in each plane the values with a 0 move to the front."""

    def __init__(self, planes: list[BitVector], size: int):
        self.planes, self.size, self.width = planes, size, len(planes)
        self.zeros = [size - int(p.before[-1]) for p in planes]

    @classmethod
    def of(cls, values: np.ndarray, width: int) -> WaveletMatrix:
        planes, cur = [], values
        for shift in range(width - 1, -1, -1):
            bit = (cur >> cur.dtype.type(shift) & cur.dtype.type(1)).astype(bool)
            planes.append(BitVector(bit))
            ones = np.flatnonzero(bit)
            zeros = np.flatnonzero(~bit)
            cur = np.concatenate((cur[zeros], cur[ones]))
        return cls(planes, len(values))

    def decode(self, dtype=np.uint32) -> np.ndarray:
        """All values: each plane deals what lies below it back into place."""
        cur = np.zeros(self.size, dtype)
        for k in range(self.width - 1, -1, -1):
            bit = self.planes[k].bits()
            up = np.empty_like(cur)
            up[np.flatnonzero(~bit)] = cur[: self.zeros[k]]
            up[np.flatnonzero(bit)] = cur[self.zeros[k] :] | dtype(1 << self.width - 1 - k)
            cur = up
        return cur

    def access(self, i: np.ndarray) -> np.ndarray:
        value = np.zeros(len(i), np.int64)
        for p, z in zip(self.planes, self.zeros):
            bit, one = p.get(i), p.rank1(i)
            value = value << 1 | bit
            i = np.where(bit == 1, z + one, i - one)
        return value

    def down(self, value: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where each position is led on a value's way below the lowest plane; two such places differ by the value's count between them."""
        for k, (p, z) in enumerate(zip(self.planes, self.zeros)):
            one = p.rank1(i)
            i = np.where(value >> self.width - 1 - k & 1, z + one, i - one)
        return i

    def rank(self, value: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each value stands in [0, i)."""
        lo = np.zeros(len(i), np.int64)
        for k, (p, z) in enumerate(zip(self.planes, self.zeros)):
            one = (value >> self.width - 1 - k & 1).astype(bool)
            a, b = p.rank1(lo), p.rank1(i)
            lo, i = np.where(one, z + a, lo - a), np.where(one, z + b, i - b)
        return i - lo

    def select(self, value: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) occurrence of one value; k must be below its count."""
        lo = np.zeros(1, np.int64)
        for j, (p, z) in enumerate(zip(self.planes, self.zeros)):
            one = p.rank1(lo)
            lo = z + one if value >> self.width - 1 - j & 1 else lo - one
        i = k + lo[0]
        for j in range(self.width - 1, -1, -1):
            p, z = self.planes[j], self.zeros[j]
            i = p.select(1, i - z) if value >> self.width - 1 - j & 1 else p.select(0, i)
        return i
