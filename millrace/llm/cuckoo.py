"""A cuckoo filter over numpy arrays: insertion, deletion and membership of 64-bit hashes (Fan et al., 2014)."""

from __future__ import annotations

import numpy as np

from millrace.llm.textkit import mix

SLOTS = 4
_KICKS = 500


class CuckooFilter:
    """Buckets of SLOTS 16-bit fingerprints; 0 is an empty slot. The bucket count is a power of two.

    A hash that was inserted is always found. One that wasn't is found with a chance of about 8/65536. Only
    hashes that were inserted may be deleted. What finds no place is kept in a list beside the buckets.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None, stash: np.ndarray | None = None) -> None:
        self.mask = buckets - 1
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16) if table is None else table
        self.stash = np.zeros((0, 2), dtype=np.int64) if stash is None else stash  # bucket and fingerprint

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        """A filter with room for n hashes at a load of at most 0.8."""
        buckets = 1
        while buckets * SLOTS * 0.8 < n:
            buckets *= 2
        return cls(buckets)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        size = int.from_bytes(raw[:8], "little")
        stash = np.frombuffer(raw, dtype="<i8", count=2 * size, offset=8).reshape(-1, 2).copy()
        table = np.frombuffer(raw, dtype="<u2", offset=8 + 16 * size).reshape(-1, SLOTS).copy()
        return cls(len(table), table, stash)

    def to_bytes(self) -> bytes:
        return len(self.stash).to_bytes(8, "little") + self.stash.astype("<i8").tobytes() + self.table.astype("<u2").tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (hashes >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (hashes & np.uint64(self.mask)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(hashes)
        found = (self.table[first] == mark[:, None]).any(axis=1) | (self.table[second] == mark[:, None]).any(axis=1)
        for bucket, own in self.stash.tolist():
            found |= (mark == own) & ((first == bucket) | (second == bucket))
        return found

    def _exchange(self, old: np.ndarray, new: np.ndarray, buckets: tuple[np.ndarray, ...]) -> np.ndarray:
        """Put new[i] in a slot of one of the i-th buckets that holds old[i]; the numbers of those without such a slot.

        In each round every bucket takes one of those that want it.
        """
        left = np.arange(len(old))
        for bucket in buckets:
            while len(left):
                at = bucket[left]
                _, one = np.unique(at, return_index=True)
                fits = self.table[at[one]] == old[left[one], None]
                takes = fits.any(axis=1)
                if not takes.any():
                    # a bucket that refuses one may still take another that asks for something else
                    fits = self.table[at] == old[left, None]
                    if not fits.any():
                        break
                    one = np.flatnonzero(fits.any(axis=1))[:1]
                    fits, takes = fits[one], np.ones(1, dtype=bool)
                one, fits = one[takes], fits[takes]
                self.table[at[one], fits.argmax(axis=1)] = new[left[one]]
                left = np.delete(left, one)
        return left

    def insert(self, hashes: np.ndarray) -> None:
        marks, firsts, seconds = self._places(hashes)
        for k in self._exchange(np.zeros_like(marks), marks, (firsts, seconds)).tolist():
            mark, bucket = int(marks[k]), int(seconds[k])
            for kick in range(_KICKS):
                slot = (kick * 7 + mark) % SLOTS
                mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
                bucket = int(self._other(np.array([bucket]), np.array([mark], dtype=np.uint16))[0])
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = mark
                    break
            else:
                self.stash = np.vstack([self.stash, [[bucket, mark]]])

    def delete(self, hashes: np.ndarray) -> None:
        marks, firsts, seconds = self._places(hashes)
        for k in self._exchange(marks, np.zeros_like(marks), (firsts, seconds)).tolist():
            held = np.flatnonzero((self.stash[:, 1] == marks[k]) & ((self.stash[:, 0] == firsts[k]) | (self.stash[:, 0] == seconds[k])))
            self.stash = np.delete(self.stash, held[:1], axis=0)
