"""A cuckoo filter over 64-bit hashes, in arrays: buckets of four 16-bit fingerprints."""

from __future__ import annotations

import numpy as np

from textloom.llm.batches import mix

SLOTS = 4


class CuckooFilter:
    def __init__(self, capacity: int):
        buckets = 1 << max(0, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.85)))))
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        out = cls(1)
        out.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return out

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _mask(self) -> np.uint64:
        return np.uint64(len(self.table) - 1)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0), first and second bucket of each."""
        finger = ((hashes >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (hashes & self._mask()).astype(np.int64)
        return finger, first, self._other(first, finger)

    def _other(self, bucket: np.ndarray, finger: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(finger.astype(np.uint64)) & self._mask()).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        finger, first, second = self._places(hashes)
        return ((self.table[first] == finger[:, None]) | (self.table[second] == finger[:, None])).any(1)

    def insert(self, hashes: np.ndarray, rounds: int = 600) -> bool:
        """Insert each hash once more; False if some found no place (the filter is then not to be used)."""
        finger, bucket, other = self._places(hashes)
        rng = np.random.default_rng(len(hashes))
        for _ in range(rounds):
            left = self._settle(finger, bucket)
            finger, bucket, other = finger[left], bucket[left], other[left]
            left = self._settle(finger, other)
            finger, bucket, other = finger[left], bucket[left], other[left]
            if not len(finger):
                return True
            at = np.unique(bucket, return_index=True)[1]  # all are full: each takes another's place, one for each bucket
            slot = rng.integers(0, SLOTS, len(at))
            out = self.table[bucket[at], slot]
            self.table[bucket[at], slot] = finger[at]
            finger[at], other[at] = out, bucket[at]
            bucket[at] = self._other(bucket[at], out)
        return False

    def _settle(self, finger: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; which are left over."""
        left = np.ones(len(finger), bool)
        while True:  # one for each bucket at a time
            at = np.flatnonzero(left & (self.table[bucket] == 0).any(1))
            if not len(at):
                return left
            at = at[np.unique(bucket[at], return_index=True)[1]]
            self.table[bucket[at], (self.table[bucket[at]] == 0).argmax(1)] = finger[at]
            left[at] = False

    def delete(self, hashes: np.ndarray) -> None:
        """Take one fingerprint of each hash out; only hashes that were inserted may be given."""
        finger, first, second = self._places(hashes)
        left = np.ones(len(finger), bool)
        for where in (first, second):
            while True:
                found = (self.table[where] == finger[:, None]) & left[:, None]
                at = np.flatnonzero(found.any(1))
                if not len(at):
                    break
                slot = found[at].argmax(1)
                keep = np.unique(where[at] * SLOTS + slot, return_index=True)[1]
                self.table[where[at[keep]], slot[keep]] = 0
                left[at[keep]] = False
