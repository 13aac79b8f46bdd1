"""A minimal perfect hash of 64-bit keys in numpy: a cascade of bit arrays with ranks, and the keys stored by slot.

A level hashes the keys still open into GAMMA bits a key; keys alone in their bit settle there, the others go on to the
next level. A key's slot is the number of set bits before its own, so n keys have the slots 0 to n - 1. A key that is not
in the set finds some slot as well; the key stored there tells it apart, so lookups are exact.
"""

from __future__ import annotations

import numpy as np

GAMMA, LEVELS = 2, 64
U = np.uint64


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + U((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


class PerfectHash:
    """Slots of distinct int64 keys."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, dtype=np.int64)
        self.size, self.levels, before = len(keys), [], 0
        still = keys.view(U)
        for level in range(LEVELS):
            if not len(still):
                break
            bits = max(64, GAMMA * len(still))
            at = (_mixed(still, level) % U(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            words = np.packbits(alone, bitorder="little")
            words = np.concatenate([words, np.zeros(-len(words) % 8, np.uint8)]).view(U)
            ranks = before + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((bits, words, ranks[:-1]))
            before, still = int(ranks[-1]), still[~alone[at]]
        if len(still):
            raise ValueError("keys of a perfect hash must be distinct")
        self.keys = np.zeros(len(keys), dtype=np.int64)
        self.keys[self._slots(keys)] = keys

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        x, who = keys.view(U), np.arange(len(keys))
        for level, (bits, words, ranks) in enumerate(self.levels):
            if not len(who):
                break
            at = (_mixed(x, level) % U(bits)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(U)
            hit = (word >> bit) & U(1) != 0
            out[who[hit]] = (ranks[at >> 6] + np.bitwise_count(word & ((U(1) << bit) - U(1))))[hit]
            x, who = x[~hit], who[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 if it is not in the set."""
        keys = np.asarray(keys, dtype=np.int64)
        if not self.size:
            return np.full(len(keys), -1, dtype=np.int64)
        slots = self._slots(keys)
        return np.where((slots >= 0) & (self.keys[slots] == keys), slots, -1)
