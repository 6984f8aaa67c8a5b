"""Suffix sorting by external induced sorting.

Suffixes are queued by their first byte. The queues are drained in order of the byte, first the L-type suffixes
of a byte, then its sorted S-type seeds, and each drained suffix induces the one before it, which enters the
queue of its own first byte; a second sweep from above induces the S-type suffixes. Since entries enter every
queue in sorted order, the queues together are a priority queue over (byte, rank) tuples. They move whole runs
of tuples at a time and go to a scratch file once they exceed a memory limit, so only the text itself and one
queue's run must fit in memory.

Seeds are the leftmost S-type suffixes. A first induction sorts the substrings between them, which are named;
the recursion on the string of names refines equal names by the names behind them, doubling the reach, until
all are different or the reach exceeds the depth that is asked for.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of queued tuples in memory before queues go to disk.
QUEUE_BYTES = 4 << 20


class ByteQueues:
    """One first-in first-out queue of suffixes for each byte, spilled to an anonymous scratch file when large."""

    def __init__(self, limit: int = QUEUE_BYTES) -> None:
        self.runs: list[list] = [[] for _ in range(256)]
        self.limit, self.held, self.file = limit, 0, None

    def push(self, suffixes: np.ndarray, first: np.ndarray) -> None:
        """Append suffixes in sorted order; ``first`` has their first bytes."""
        if not len(suffixes):
            return
        order = np.argsort(first, kind="stable")
        suffixes, first = suffixes[order], first[order]
        edges = np.flatnonzero(first[1:] != first[:-1]) + 1
        for run, byte in zip(np.split(suffixes, edges), first[np.r_[0, edges]].tolist(), strict=True):
            self.runs[byte].append(run)
        self.held += suffixes.nbytes
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for runs in self.runs:
            kept = [r for r in runs if isinstance(r, np.ndarray)]
            if kept:
                whole = np.concatenate(kept)
                place = (self.file.tell(), len(whole), whole.dtype)
                self.file.write(whole.tobytes())
                runs[:] = [*(r for r in runs if not isinstance(r, np.ndarray)), place]
        self.held = 0

    def take(self, byte: int) -> np.ndarray | None:
        """All suffixes queued for ``byte``, in order; the queue is empty afterwards."""
        runs, self.runs[byte] = self.runs[byte], []
        if not runs:
            return None
        out = []
        for r in runs:
            if isinstance(r, np.ndarray):
                self.held -= r.nbytes
                out.append(r)
            else:
                self.file.seek(r[0])
                out.append(np.frombuffer(self.file.read(r[1] * r[2].itemsize), r[2]))
        return np.concatenate(out)

    def close(self) -> None:
        if self.file:
            self.file.close()


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor (S-type); the last one is."""
    n = len(text)
    differs = np.empty(n, np.int64)
    differs[-1] = n - 1
    differs[:-1] = np.where(text[:-1] != text[1:], np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(differs[::-1])[::-1]
    small = np.ones(n, bool)
    inner = at < n - 1
    small[inner] = text[at[inner]] < text[at[inner] + 1]
    return small


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, limit: int) -> list[np.ndarray]:
    """All suffixes in sorted order, as runs, from the seeds in sorted order."""
    byte_of = text[seeds]
    bounds = np.searchsorted(byte_of, np.arange(257))
    queues = ByteQueues(limit)
    large: list[np.ndarray] = []
    none = seeds[:0]

    def before(suffixes: np.ndarray, want_small: bool, byte: int, into: ByteQueues) -> np.ndarray | None:
        p = suffixes[suffixes > 0] - 1
        p = p[small[p] == want_small]
        first = text[p]
        same = first == byte
        if same.any():
            into.push(p[~same], first[~same])
            return p[same]
        into.push(p, first)
        return None

    for byte in range(256):
        out, wave = [], queues.take(byte)
        while wave is not None and len(wave):
            out.append(wave)
            wave = before(wave, False, byte, queues)
        large.append(np.concatenate(out) if out else none)
        own = seeds[bounds[byte] : bounds[byte + 1]]
        if len(own):
            before(own, False, -1, queues)
    queues.close()
    queues = ByteQueues(limit)
    runs: list[np.ndarray] = []
    for byte in range(255, -1, -1):
        out, wave = [], queues.take(byte)
        while wave is not None and len(wave):
            out.append(wave[::-1])
            wave = before(wave, True, byte, queues)
        if byte == text[-1]:
            out.append(np.array([len(text) - 1], seeds.dtype))
        runs += out
        runs.append(large[byte])
        if len(large[byte]):
            before(large[byte][::-1], True, -1, queues)
    queues.close()
    return runs[::-1]


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, without copying."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    return np.ndarray((len(text),), "<u8", padded, strides=(1,))


def _same(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Whether ``length`` bytes from ``a`` and from ``b`` on agree."""
    n = np.broadcast_to(np.asarray(length), a.shape)
    equal = np.ones(len(a), bool)
    todo = np.arange(len(a))
    k, last = 0, len(words) - 1
    while len(todo):
        rest = n[todo] - k
        todo, rest = todo[rest > 0], rest[rest > 0]
        diff = words[np.minimum(a[todo] + k, last)] ^ words[np.minimum(b[todo] + k, last)]
        short = rest < 8
        diff[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
        equal[todo[diff != 0]] = False
        todo = todo[diff == 0]
        k += 8
    return equal


def _refine(names: np.ndarray, reach: int) -> np.ndarray:
    """Order of the suffixes of the string of names, right for at least ``reach`` names.

    A rank is the place of the first of its group; only groups of several are sorted again.
    """
    m = len(names)
    order = np.argsort(names, kind="stable")
    sorted_names = names[order]
    head = np.flatnonzero(np.r_[True, sorted_names[1:] != sorted_names[:-1]])
    rank = np.empty(m + 1, np.int64)
    rank[m] = -1
    rank[order] = np.repeat(head, np.diff(np.r_[head, m]))
    step = 1
    while step < reach:
        sizes = np.bincount(rank[:m], minlength=m)
        todo = np.flatnonzero(sizes[rank[:m]] > 1)
        if not len(todo):
            break
        behind = rank[np.minimum(todo + step, m)]
        by = np.lexsort((behind, rank[todo]))
        todo, behind = todo[by], behind[by]
        group = rank[todo]
        new_group = np.r_[True, group[1:] != group[:-1]]
        new_rank = np.r_[True, (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])]
        at = np.arange(len(todo))
        offset = np.maximum.accumulate(np.where(new_rank, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
        rank[todo] = group + offset
        step *= 2
    return np.argsort(rank[:m], kind="stable")


def suffix_order(text: np.ndarray, depth: int, limit: int = QUEUE_BYTES) -> np.ndarray:
    """The suffixes of ``text`` in an order that is right for at least ``depth`` bytes.

    The last byte must be 0, and no two zeros may be next to each other.
    """
    kind = np.int32 if len(text) < 2**31 else np.int64
    small = _types(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(kind)
    if len(lms) < 2:
        return np.concatenate(_induce(text, small, lms, limit)).astype(kind)
    first = lms[np.argsort(text[lms], kind="stable")]
    is_seed = np.zeros(len(text), bool)
    is_seed[lms] = True
    rough = np.concatenate([r[is_seed[r]] for r in _induce(text, small, first, limit)])
    number = np.empty(len(text), kind)
    number[lms] = np.arange(len(lms))
    place = number[rough]
    ends = np.r_[lms[1:], len(text) - 1]
    length = (ends - lms + 1)[place].astype(np.int64)
    same = np.zeros(len(rough), bool)
    alike = np.flatnonzero(length[1:] == length[:-1]) + 1
    words = _words(text)
    same[alike] = _same(words, rough[alike - 1].astype(np.int64), rough[alike].astype(np.int64), length[alike])
    names = np.empty(len(lms), np.int64)
    names[place] = np.cumsum(~same) - 1
    seeds = lms[_refine(names, depth // 2 + 2)]
    return np.concatenate(_induce(text, small, seeds, limit))


def repeated(windows: list[bytes], length: int, limit: int = QUEUE_BYTES) -> list[np.ndarray]:
    """For each window, whether the ``length`` bytes from each start on occur at another place of the windows.

    Windows may hold any byte. 0 and 1 get an escape of their own: bytes move up by one, the two highest share
    the top code with a second comparison on the original bytes.
    """
    sizes = np.array([len(w) for w in windows], np.int64)
    raw = np.frombuffer(b"\x00".join(windows) + b"\x00", np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.minimum(raw, 254).astype(np.uint8) + np.uint8(1)
    text[starts + sizes] = 0
    order = suffix_order(text, length, limit)
    usable = np.zeros(len(text), bool)
    for lo, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        usable[lo : lo + max(0, n - length + 1)] = True
    order = order[usable[order]].astype(np.int64)
    again = np.zeros(len(text), bool)
    equal = np.flatnonzero(_same(_words(text), order[:-1], order[1:], length))
    if (raw == 255).any():
        again[_resolved(raw, order, equal, length)] = True
    else:
        again[order[equal]] = True
        again[order[equal + 1]] = True
    return [again[lo : lo + max(0, n - length + 1)] for lo, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _resolved(raw: np.ndarray, order: np.ndarray, equal: np.ndarray, length: int) -> list[int]:
    """Starts that repeat by their original bytes, within each run of suffixes that agree on the shared code."""
    out: list[int] = []
    run = np.split(equal, np.flatnonzero(np.diff(equal) != 1) + 1) if len(equal) else []
    for part in run:
        seen: dict[bytes, list[int]] = {}
        for p in order[part[0] : part[-1] + 2].tolist():
            seen.setdefault(raw[p : p + length].tobytes(), []).append(p)
        out += [p for places in seen.values() if len(places) > 1 for p in places]
    return out
