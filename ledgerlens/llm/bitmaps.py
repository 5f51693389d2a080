"""Minimal perfect hashing by levels of bit arrays, in numpy.

A level is a bit array about twice as long as the keys it gets; keys that
meet no other key there keep their bit, the rest go to the next level.  A
key's index is the number of kept bits before its own, so the indices of n
keys are exactly 0 .. n - 1.  Keys are pairs of 64-bit values.
"""

from __future__ import annotations

import numpy as np

from ledgerlens.llm.words import U64, mix64

_GAMMA = 2


def _slots(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    mixed = mix64(h1 + mix64(h2 ^ mix64(np.full(1, level + 1, U64))))
    return (mixed % U64(size)).astype(np.int64)


def build(h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """Bit arrays (one byte a bit) of the levels for distinct keys."""
    levels = []
    left = np.arange(len(h1))
    while len(left):
        size = max(8, _GAMMA * len(left))
        slot = _slots(h1[left], h2[left], len(levels), size)
        alone = np.bincount(slot, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[slot]]
    return levels


def pack(levels: list[np.ndarray]) -> tuple[bytes, list[int]]:
    return b"".join(np.packbits(x).tobytes() for x in levels), [len(x) for x in levels]


class Lookup:
    """Index of keys; a key that was not built in gets any index or -1."""

    def __init__(self, packed: bytes, sizes: list[int]) -> None:
        data = np.frombuffer(packed, np.uint8)
        self.levels, self.before = [], []
        start = seen = 0
        for size in sizes:
            n = -(-size // 8)
            bits = np.unpackbits(data[start:start + n], count=size).astype(bool)
            rank = np.cumsum(bits, dtype=np.int64) - 1 + seen
            self.levels.append(bits)
            self.before.append(rank)
            seen += int(bits.sum())
            start += n

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, (bits, rank) in enumerate(zip(self.levels, self.before, strict=True)):
            if not len(left):
                break
            slot = _slots(h1[left], h2[left], level, len(bits))
            hit = bits[slot]
            out[left[hit]] = rank[slot[hit]]
            left = left[~hit]
        return out
