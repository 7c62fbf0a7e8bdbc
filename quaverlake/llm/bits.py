"""Bit vectors with ranks, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Bits:
    """A bit vector with ranks: 64 bits a word, and the ones before each word."""

    words: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, packed: bytes) -> Bits:
        words = np.frombuffer(packed, np.uint64)
        return cls(words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0


def packed(bits: np.ndarray) -> bytes:
    """Bits in 64-bit words, with at least one word beyond them, so that the rank of their end can be asked."""
    raw = np.packbits(bits, bitorder="little").tobytes()
    return raw + bytes(8 + -len(raw) % 8)
