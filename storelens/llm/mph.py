"""Minimal perfect hashing of 32-bit keys, by cascading bit tables.

Each level hashes the keys left over into a table of twice their number; keys that are alone in their slot
set its bit, the rest go on to the next level. A key's index is the number of set bits before its own.
"""

from __future__ import annotations

import numpy as np

SLOTS = 2


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        """``keys``: distinct unsigned 32-bit numbers."""
        sizes, tables, left = [], [], keys
        while len(left):
            size = SLOTS * len(left)
            at = _slot(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            tables.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(tables) if tables else np.zeros(0, bool))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Of a key that was built in its own number below the number of keys; of another one any such number, or -1."""
        out, left, first = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = first + _slot(keys[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.before[at[hit]]
            left, first = left[~hit], first + size
            if not len(left):
                break
        return out

    def to_bytes(self) -> bytes:
        return np.array([len(self.sizes), *self.sizes], "<i8").tobytes() + np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "PerfectHash":
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = np.frombuffer(data, "<i8", n, 8).tolist()
        return cls(sizes, np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + 8 * n), count=sum(sizes)).astype(bool))
