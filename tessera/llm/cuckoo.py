"""A cuckoo filter over 64-bit hashes, held in one numpy array."""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Share of filled slots up to which keys are added; beyond it evictions grow long and a new filter is cheaper.
LOAD = 0.85
_KICKS = 500
_SPREAD = np.uint64(0x5BD1E995)


class CuckooFilter:
    """Membership with deletion: buckets of four 16-bit fingerprints, two candidate buckets per item.

    Filled slots of a bucket come first; zero marks a free slot. A filter that overflows doubles, which needs
    the hashes again, so ``add`` takes a callable that yields all of them only in that case.
    """

    def __init__(self, capacity: int) -> None:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.8)))))
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        made = cls(1)
        made.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return made

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        mark = ((hashes >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = hashes & mask
        return mark, first.astype(np.int64), (first ^ (mark.astype(np.uint64) * _SPREAD & mask)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(hashes)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Insert the hashes; those that found no place are returned."""
        mark, a, b = self._places(hashes)
        left = np.arange(len(hashes))
        for side in (a, b):
            order = left[np.argsort(side[left], kind="stable")]
            bucket = side[order]
            start = np.r_[True, bucket[1:] != bucket[:-1]] if len(bucket) else np.zeros(0, bool)
            rank = np.arange(len(bucket)) - np.maximum.accumulate(np.where(start, np.arange(len(bucket)), 0))
            slot = (self.table[bucket] != 0).sum(1) + rank
            fits = slot < SLOTS
            self.table[bucket[fits], slot[fits]] = mark[order[fits]]
            left = order[~fits]
        failed = [i for i in left.tolist() if not self._kick(int(mark[i]), int(b[i]))]
        return hashes[failed]

    def _kick(self, mark: int, bucket: int) -> bool:
        mask, path = len(self.table) - 1, []
        for turn in range(_KICKS):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
            slot = turn % SLOTS
            path.append((bucket, slot, int(self.table[bucket, slot])))
            self.table[bucket, slot], mark = mark, path[-1][2]
            bucket ^= mark * int(_SPREAD) & mask
        for bucket, slot, old in reversed(path):
            self.table[bucket, slot] = old
        return False

    def has_room(self, more: int) -> bool:
        return np.count_nonzero(self.table) + more <= LOAD * self.table.size

    def remove(self, hashes: np.ndarray) -> None:
        """Delete one copy of each hash; hashes must have been added before."""
        for mark, *places in zip(*(x.tolist() for x in self._places(hashes)), strict=True):
            for bucket in places:
                at = np.flatnonzero(self.table[bucket] == mark)
                if len(at):
                    last = int((self.table[bucket] != 0).sum()) - 1
                    self.table[bucket, at[0]] = self.table[bucket, last]
                    self.table[bucket, last] = 0
                    break


def build(hashes: np.ndarray, spare: int = 0) -> CuckooFilter:
    """A filter that holds all ``hashes``, with room for ``spare`` more; doubled until everything fits."""
    capacity = len(hashes) + spare
    while True:
        made = CuckooFilter(capacity)
        if not len(made.add(hashes)):
            return made
        capacity = max(8, capacity * 2)
