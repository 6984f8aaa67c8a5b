"""Content-defined anchors: every string of a given length has exactly one, and equal strings have equal ones.

A string of ``length`` bytes holds ``length - GRAM + 1`` grams; its anchor is the leftmost gram with the least
hash. Two equal strings have their anchors at the same place in the string and with the same hash, so strings
with different anchor hashes are different. Neighbouring starts mostly share an anchor.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(3)
_TABLE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POSITION = np.uint64((1 << 24) - 1)
#: Bytes looked at at once, so positions fit beside the hash.
SPAN = 1 << 22


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)


def _grow(n: int) -> None:
    global _UP, _DOWN
    if len(_UP) < n:
        size = 1 << int(n - 1).bit_length()
        _UP, _DOWN = _powers(_BASE, size), _powers(_INVERSE, size)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed rolling hash of every ``gram`` consecutive bytes."""
    n = len(data)
    _grow(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _UP[:n], out=total[1:])
    h = (total[gram:] - total[:-gram]) * _DOWN[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys, from prefix and suffix minima of blocks."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): for each anchor its hash and the range of starts of the strings that have it."""
    gram = length // 2
    width = length - gram + 1
    found = []
    for lo in range(0, len(data) - length + 1, SPAN):
        part = np.frombuffer(data, np.uint8, min(SPAN + length - 1, len(data) - lo), lo)
        h = gram_hashes(part, gram)
        keys = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        at = (_least(keys, width) & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:] - 1, len(at) - 1]
        found.append((h[at[first]].view(np.int64), first + lo, last + lo))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def anchor_place(data: bytes, length: int) -> int:
    """Where the anchor of the first string of ``data`` begins."""
    gram = length // 2
    h = gram_hashes(np.frombuffer(data, np.uint8, length), gram)
    return int(np.argmin(h & ~_POSITION))
