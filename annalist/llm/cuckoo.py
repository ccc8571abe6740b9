"""A cuckoo filter over 64-bit digests, inserting and deleting whole arrays."""

from __future__ import annotations

import numpy as np

from annalist.llm.words import mix

SLOTS = 4
_KICKS = 200


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four slots, each at one of two buckets.

    Never forgets what was inserted and not deleted; may claim what was never inserted.
    Delete only what was inserted. When it gets full, it asks for a larger one.
    """

    def __init__(self, capacity: int = 0, blob: bytes | None = None):
        if blob is not None:
            self.table = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        else:
            # At most 80 % of the slots are to be used.
            buckets = 1 << max(4, int(np.ceil(capacity / (SLOTS * 0.8))).bit_length())
            self.table = np.zeros((buckets, SLOTS), np.uint16)

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    @property
    def capacity(self) -> int:
        return int(self.table.size * 0.8)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _fingerprints(self, digests: np.ndarray) -> np.ndarray:
        marks = (digests >> np.uint64(48)).astype(np.uint16)
        return np.where(marks == 0, np.uint16(1), marks)  # zero is an empty slot

    def _first(self, digests: np.ndarray) -> np.ndarray:
        return (digests & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(marks.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, digests: np.ndarray) -> np.ndarray:
        marks, first = self._fingerprints(digests), self._first(digests)
        second = self._other(first, marks)
        return ((self.table[first] == marks[:, None]) | (self.table[second] == marks[:, None])).any(axis=1)

    def _place(self, buckets: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets, one per bucket; which found one."""
        free = self.table[buckets] == 0
        chosen = np.zeros(len(buckets), bool)
        chosen[np.unique(buckets, return_index=True)[1]] = True
        done = chosen & free.any(axis=1)
        self.table[buckets[done], free[done].argmax(axis=1)] = marks[done]
        return done

    def insert(self, digests: np.ndarray) -> bool:
        """Insert each digest once; False if there is no room (the filter is then spoilt)."""
        marks, at = self._fingerprints(digests), self._first(digests)
        for turn in range(_KICKS):
            if not len(marks):
                return True
            for _ in range(SLOTS):  # several marks may want one bucket
                done = self._place(at, marks)
                marks, at = marks[~done], at[~done]
            at = self._other(at, marks)
            if turn % 2:
                # Both buckets were full: take the place of another mark, one per bucket.
                lone = np.unique(at, return_index=True)[1]
                slot = turn // 2 % SLOTS
                kicked = self.table[at[lone], slot]
                self.table[at[lone], slot] = marks[lone]
                marks[lone] = kicked
                # An empty slot may have been met; nothing was driven out of it.
                moved = np.ones(len(marks), bool)
                moved[lone] = kicked != 0
                at[lone] = self._other(at[lone], kicked)
                marks, at = marks[moved], at[moved]
        return not len(marks)

    def delete(self, digests: np.ndarray) -> None:
        """Remove one fingerprint for each digest."""
        marks, first = self._fingerprints(digests), self._first(digests)
        for mark, bucket, other in zip(marks, first, self._other(first, marks), strict=True):
            for b in (bucket, other):
                slot = np.flatnonzero(self.table[b] == mark)
                if len(slot):
                    self.table[b, slot[0]] = 0
                    break
