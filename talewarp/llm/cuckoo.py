"""A cuckoo filter over 128-bit keys, in numpy, whose operations take arrays of keys.

Four slots of 16 bits a bucket; a key may lie in either of two buckets, each of which can
be told from the other and the fingerprint alone. Distinct keys that share fingerprint and
buckets keep a copy each, so a key can be removed again. A filter never denies a key that
it holds; it affirms about one in 8000 others.
"""

from __future__ import annotations

import numpy as np

SLOTS, LOAD, KICKS = 4, 0.9, 200
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Cuckoo:
    """``table`` has a row of slots a bucket, filled from the left; zero is a free slot."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of_size(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(2, int(np.ceil(np.log2(keys / LOAD / SLOTS))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    @property
    def room(self) -> int:
        return max(0, int(self.table.size * LOAD) - len(self))

    def _mark(self, low: np.ndarray) -> np.ndarray:
        return np.maximum(low >> np.uint64(48), np.uint64(1)).astype(np.uint16)

    def _bucket(self, high: np.ndarray) -> np.ndarray:
        return (high & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (((mark.astype(np.uint64) * _SPREAD) >> np.uint64(32)).astype(np.int64) & (len(self.table) - 1))

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        mark, bucket = self._mark(low), self._bucket(high)
        return ((self.table[bucket] == mark[:, None]) | (self.table[self._other(bucket, mark)] == mark[:, None])).any(axis=1)

    def _put(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Places what fits into its bucket; tells what didn't."""
        by = np.argsort(bucket, kind="stable")
        sorted_ = bucket[by]
        slot = np.count_nonzero(self.table[sorted_], axis=1) + np.arange(len(by)) - np.searchsorted(sorted_, sorted_)
        fits = slot < SLOTS
        self.table[sorted_[fits], slot[fits]] = mark[by[fits]]
        out = np.ones(len(by), bool)
        out[by[fits]] = False
        return out

    def insert(self, high: np.ndarray, low: np.ndarray) -> None:
        """Add distinct keys, ``room`` of them at most; where moves don't end, nothing is added and OverflowError raised."""
        before = self.table.copy()
        mark, bucket = self._mark(low), self._bucket(high)
        for turn in range(KICKS):
            for _ in range(2):
                rest = self._put(bucket, mark)
                bucket, mark = bucket[rest], mark[rest]
                if not len(mark):
                    return
                bucket = self._other(bucket, mark)
            _, one = np.unique(bucket, return_index=True)
            slot = (mark[one].astype(np.int64) + turn) % SLOTS
            moved = self.table[bucket[one], slot]
            self.table[bucket[one], slot] = mark[one]
            mark[one] = moved
            bucket[one] = self._other(bucket[one], moved)
        self.table = before
        raise OverflowError("the filter is full")

    def remove(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Take one copy of each of distinct keys out; tells which were there."""
        mark, bucket = self._mark(low), self._bucket(high)
        gone = np.zeros(len(mark), bool)
        waiting = np.arange(len(mark))
        for side in (bucket, self._other(bucket, mark)):
            left = waiting
            while len(left):
                _, one = np.unique(side[left], return_index=True)  # one key a bucket at a time
                k = left[one]
                same = self.table[side[k]] == mark[k, None]
                hit, slot = same.any(axis=1), same.argmax(axis=1)
                k, slot = k[hit], slot[hit]
                last = np.count_nonzero(self.table[side[k]], axis=1) - 1
                self.table[side[k], slot] = self.table[side[k], last]
                self.table[side[k], last] = 0
                gone[k] = True
                left = np.delete(left, one)
            waiting = waiting[~gone[waiting]]
        return gone


class Stack:
    """Filters of one size: when the last one is full, a further one follows.

    As they are equally large, two keys that can be taken for each other in one filter can
    be in each, so it doesn't matter which of the copies is removed.
    """

    def __init__(self, keys: int, filters: list[Cuckoo] | None = None):
        self.keys, self.filters = keys, filters or []

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        found = np.zeros(len(high), bool)
        for one in self.filters:
            found[~found] = one.contains(high[~found], low[~found])
        return found

    def insert(self, high: np.ndarray, low: np.ndarray) -> None:
        """Add distinct keys."""
        at, most = 0, len(high)
        while at < len(high):
            if not self.filters or not self.filters[-1].room:
                self.filters.append(Cuckoo.of_size(self.keys))
            upto = min(at + self.filters[-1].room, at + most, len(high))
            try:
                self.filters[-1].insert(high[at:upto], low[at:upto])
                at = upto
            except OverflowError:
                most = max(1, (upto - at) // 2)  # more than eight of them may share their buckets and mark
                self.filters.append(Cuckoo.of_size(self.keys))

    def remove(self, high: np.ndarray, low: np.ndarray) -> None:
        """Take keys out that were added before."""
        for one in self.filters:
            gone = one.remove(high, low)
            high, low = high[~gone], low[~gone]
        if len(high):
            raise KeyError("a key is removed that was never added")

    def __len__(self) -> int:
        return sum(map(len, self.filters))

    def dump(self) -> list[bytes]:
        return [f.table.tobytes() for f in self.filters]

    @classmethod
    def load(cls, keys: int, tables: list[bytes]) -> Stack:
        return cls(keys, [Cuckoo(np.frombuffer(t, np.uint16).reshape(-1, SLOTS).copy()) for t in tables])
