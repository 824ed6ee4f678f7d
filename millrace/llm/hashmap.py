"""A map from 64-bit integers to non-negative int32 values over numpy arrays, by open addressing."""

from __future__ import annotations

import numpy as np

from millrace.llm.textkit import mix


class HashMap64:
    """Look-ups and insertions of many keys at once. Keys inserted together must differ, and be new."""

    def __init__(self, bits: int = 12) -> None:
        self.bits, self.count = bits, 0
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        mask, at = (1 << self.bits) - 1, self._home(keys)
        value = self.values[at]
        same = self.keys[at] == keys
        found = np.where(same, value, np.int32(-1))
        left = np.flatnonzero(~same & (value >= 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            value, same = self.values[at[left]], self.keys[at[left]] == keys[left]
            found[left] = np.where(same, value, np.int32(-1))
            left = left[~same & (value >= 0)]
        return found

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.count += len(keys)
        if self.count * 3 > 1 << self.bits:
            old = self.values >= 0
            keys, values = np.concatenate((self.keys[old], keys)), np.concatenate((self.values[old], values))
            while self.count * 3 > 1 << self.bits:
                self.bits += 1
            self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
            self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        mask, at, left = (1 << self.bits) - 1, self._home(keys), np.arange(len(keys))
        claim = np.full(1 << self.bits, -1, dtype=np.int32) if len(keys) else self.values
        while len(left):
            free = left[self.values[at[left]] < 0]
            claim[at[free]] = free  # of several for one place, the last gets it
            won = free[claim[at[free]] == free]
            self.values[at[won]], self.keys[at[won]] = values[won], keys[won]
            rest = np.ones(len(keys), dtype=bool)
            rest[won] = False
            left = left[rest[left]]
            at[left] = (at[left] + 1) & mask
