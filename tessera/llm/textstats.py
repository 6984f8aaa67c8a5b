"""Per-text statistics shared by the quality rules and the quality classifier.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``; ``bytes.split()`` without an argument splits at exactly
those six bytes, and UTF-8 never uses them inside a multi-byte character.
"""

from __future__ import annotations

import numpy as np

WINDOW = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_DIGITS = b"0123456789"
_UPPER = bytes(range(65, 91))
_PUNCT = b".,;:!?'\"()[]{}-_/\\"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_distinct", "n_digits", "n_upper", "n_punct", "n_stutter", "n_short", "n_bytes", "longest_word")


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by a window of ``window`` words that occurs at least twice in the list.

    A wrapping rolling hash finds candidate windows; the windows themselves are then compared, so a hash
    collision cannot change the count.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * _MIX + h[k : k + n]
    order = np.sort(rolled)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(rolled, twice)).tolist()
    places: dict[tuple, list[int]] = {}
    for i in at:
        places.setdefault(tuple(words[i : i + window]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for found in places.values():
        if len(found) > 1:
            np.add.at(edge, found, 1)
            np.add.at(edge, np.asarray(found) + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_stats(text: str | None) -> tuple[int, ...]:
    """The five counts of ``BASE``; a null text has none of anything."""
    if not text:
        return (0, 0, 0, 0, 0)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line not in seen:
            seen.add(line)
        elif line.strip():
            dup += 1
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        dup,
        repeat_words(words),
    )


def full_stats(text: str | None) -> tuple[int, ...]:
    """``base_stats`` followed by the counts of ``EXTRA``."""
    base = base_stats(text)
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    size = len(data)
    return base + (
        data.count(b"\n") + 1,
        len(set(words)),
        size - len(data.translate(None, _DIGITS)),
        size - len(data.translate(None, _UPPER)),
        size - len(data.translate(None, _PUNCT)),
        sum(map(bytes.__eq__, words, words[1:])),
        sum(len(w) < 3 for w in words),
        size,
        max(map(len, words), default=0),
    )
