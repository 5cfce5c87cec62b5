"""Byte ranges as blocks of eight bytes, for hashing and comparing many of them at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MASK = np.array([0, *[(1 << 8 * k) - 1 for k in range(1, 9)]], _U)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit words in which every bit depends on every other."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Ranges:
    """Non-empty ranges [starts, stops) of some bytes as words of eight bytes, the last one filled with zeros."""

    def __init__(self, data: bytes, starts: np.ndarray, stops: np.ndarray) -> None:
        self.lengths = stops - starts
        self.sizes = (self.lengths + 7) >> 3
        ends = np.cumsum(self.sizes)
        #: Each range's first block; each block's place in its range.
        self.first = ends - self.sizes
        self.place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(self.first, self.sizes)
        at = np.repeat(starts, self.sizes) + 8 * self.place
        every = np.ndarray((max(1, len(data)),), "<u8", data + bytes(8), strides=(1,))
        self.blocks = every[at] & _MASK[np.minimum(np.repeat(stops, self.sizes) - at, 8)]

    def hashes(self, key: int = 0) -> np.ndarray:
        """Each block is mixed with its place and a key before blocks are added up, so that nothing cancels out by its form.

        Without the key, no texts can be made up whose hashes agree; for any two ranges they do with a chance of about 1 in 2^64.
        """
        if not len(self.sizes):
            return np.empty(0, _U)
        each = mixed(self.blocks ^ mixed(self.place.astype(_U) + (_U(0x9E3779B97F4A7C15) ^ _U(key))))
        return mixed(np.add.reduceat(each, self.first) ^ mixed(self.lengths.astype(_U)))
