"""A minimal perfect hash over 128-bit keys: cascaded bit sets, a key's number is the rank of its bit."""

from __future__ import annotations

import numpy as np

from spanledger.llm.textscan import PLACE, mix

LEVELS, ROOM = 40, 2  # bits of a level for each key that is left


def _bit(level: int, h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    return (mix(h1 ^ (h2 * PLACE[level])) % np.uint64(size)).astype(np.int64)


class MinimalHash:
    """Distinct keys (h1, h2) to 0 .. n - 1. Other keys get some number too, so members are told by a fingerprint."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes, self.begin = sizes, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(self.begin[-1])).astype(bool)
        self.rank = np.concatenate(([0], np.cumsum(self.bits))).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> "MinimalHash":
        sizes, sets = [], []
        for level in range(LEVELS):
            if not len(h1):
                break
            size = max(64, ROOM * len(h1))
            at = _bit(level, h1, h2, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            sets.append(alone)
            left = ~alone[at]
            h1, h2 = h1[left], h2[left]
        if len(h1):
            raise ValueError("equal keys")
        return cls(sizes, np.packbits(np.concatenate(sets)).tobytes() if sets else b"")

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    def number(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each key, or -1 where no level holds it."""
        out, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.begin[level] + _bit(level, h1[left], h2[left], size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return out
