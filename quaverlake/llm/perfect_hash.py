"""Minimal perfect hashes in shards, with the keys stored in the order of their slots.

A shard is built level by level: every key that is left is sent to one of as many bits as keys are left; a bit that one key alone was sent to is set, keys
that met another go on to the next level. The rank of a key's bit is its slot, so n keys take the slots 0 to n - 1. Bits cost about 2.7 a key.

Shards are put side by side for use: ranks then run through all of them, and a whole array of terms is looked up at once. A term that is not a key may
be led to a slot; it is compared with the key stored there, so every answer is exact. Keys of equal hash, which no level can part, are kept in a list.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bits import Bits, packed
from .words import mix, string_hashes

LEVELS = 24


def _place(hashes: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    h = mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1))
    return (((h >> np.uint64(32)) * np.asarray(size).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def shard_of(terms: pa.Array, shards: np.ndarray) -> np.ndarray:
    """The shard of each term where its language has so many."""
    return _place(string_hashes(terms), -2, shards)


def build(keys: pa.Array) -> tuple[list[int], bytes, pa.Array]:
    """(bits of each level, all bits, keys in the order of their slots, those without one at the end) of distinct keys."""
    hashes = string_hashes(keys)
    left, sizes, bits, order = np.arange(len(keys)), [], [], []
    while len(left) and len(sizes) < LEVELS:
        size = len(left)
        at = _place(hashes[left], len(sizes), size)
        one = np.bincount(at, minlength=size) == 1
        alone = one[at]
        order.append(left[alone][np.argsort(at[alone])])
        left = left[~alone]
        sizes.append(size)
        bits.append(one)
    return sizes, packed(np.concatenate(bits) if bits else np.zeros(0, bool)), keys.take(pa.array(np.concatenate([*order, left]).astype(np.int64)))


@dataclass
class Shards:
    """Shards side by side: known[lang] has the place of each shard of a language, -1 if it is not here; `at` is where a level's bits of a shard begin, `size` how many they are; slots of shard s begin at first[s]."""

    known: dict[str, np.ndarray]
    at: np.ndarray
    size: np.ndarray
    bits: Bits
    keys: pa.Array
    slot: np.ndarray
    first: np.ndarray
    rest: dict[tuple[int, str], int]

    @classmethod
    def of(cls, rows: list) -> Shards:
        """Of rows (lang, shard, shards, sizes, bits, keys). Slots follow the order of the rows."""
        at, size = np.zeros((len(rows), LEVELS), np.int64), np.zeros((len(rows), LEVELS), np.int64)
        words, keys, slot, rest, begin, first = [], [], [], {}, 0, [0]
        for s, r in enumerate(rows):
            n = len(r["sizes"])
            size[s, :n] = r["sizes"]
            at[s] = begin * 8 + np.cumsum(size[s]) - size[s]
            words.append(r["bits"])
            begin += len(r["bits"])
            placed = int(np.bitwise_count(np.frombuffer(r["bits"], np.uint64)).sum())
            keys += r["keys"][:placed]
            slot.append(np.arange(placed) + first[-1])
            rest |= {(s, k): first[-1] + placed + i for i, k in enumerate(r["keys"][placed:])}
            first.append(first[-1] + len(r["keys"]))
        known = {r["lang"]: np.full(r["shards"], -1) for r in rows}
        for s, r in enumerate(rows):
            known[r["lang"]][r["shard"]] = s
        return cls(known, at, size, Bits.of(b"".join(words)), pa.array(keys, pa.large_string()), np.concatenate([*slot, np.zeros(0, np.int64)]), np.array(first), rest)

    def slots(self, lang: str, terms: pa.Array, hashes: np.ndarray | None = None) -> np.ndarray:
        """The slot of each term of a language, -1 where it is no key. `hashes` are those of the terms, if they are known."""
        out = np.full(len(terms), -1, np.int64)
        if lang not in self.known:
            return out
        known, hashes = self.known[lang], string_hashes(terms) if hashes is None else hashes
        shard = known[_place(hashes, -2, len(known))]
        left = np.flatnonzero(shard >= 0)
        for level in range(LEVELS):
            size = self.size[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            at = self.at[shard[left], level] + _place(hashes[left], level, size)
            hit = self.bits.at(at)
            # The rank counts set bits, which are keys with a slot, over all shards before.
            out[left[hit]] = self.bits.rank(at[hit])
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        right = pc.equal(self.keys.take(pa.array(out[found])), terms.take(pa.array(found))).to_numpy(zero_copy_only=False)
        out[found[~right]] = -1
        out[found[right]] = self.slot[out[found[right]]]
        if self.rest:
            for i in np.flatnonzero((out < 0) & (shard >= 0)):
                out[i] = self.rest.get((int(shard[i]), terms[i].as_py()), -1)
        return out
