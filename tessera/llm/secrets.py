"""Secrets in texts, also under layers of URL, Unicode, base64 and compressed encodings.

A text is the first layer on a worklist. Every layer is searched for the three kinds of secrets, then unwrapped:

* ``url``: lines with %XX escapes, ``unicode``: lines with \\uXXXX, %uXXXX, \\u{X}, \\UXXXXXXXX, \\xXX, &#N; or &#xX;
  (no kind of secret holds a line break, so a line with its escapes replaced is all the context there is);
* ``base64``: runs of at least ``RUN`` characters of either alphabet, read from each of four places, since the run
  may have swallowed characters before it; blocks of equal lines are also read as one run;
* ``compressed``: gzip, zlib, bzip2 and xz data, wherever one of their headers is found.

What comes out is a new layer unless the same bytes have come from the same place of the text before, which ends
cycles (compressed data can hold itself). The worklist is empty at the fixpoint. Every byte of a layer knows the
first and last byte of the text that it stands for, so each finding is reported by code points of the text, with the
layers that were unwrapped. Findings of one kind with the same span are one, and keep the layers of the first.
Shorter runs of base64 than ``RUN`` cannot hold the shortest secret.

Compressed data can be a thousand times as long as its text. A layer of more than ``MOST`` bytes, or one that would
bring the layers of a text above ``TOTAL`` bytes (or 64 times the text, if that is more), is not unwrapped; it is
counted in ``n_unread`` of its row, so no text with unread layers passes for a clean one. Escapes and base64 never
make a layer longer.

A null text counts as empty and holds no secrets. Rows that repeat a doc_id or have none are searched one by one. An
empty table gives an empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex")
COMPRESSED = "compressed"
#: Least characters of a run of base64, and of the first line of a block of lines.
RUN, LINE = 19, 16
MOST, TOTAL = 16 << 20, 64 << 20
#: Bytes that a decompressor takes and gives at a time.
CHUNK = 1 << 16

#: Type of the findings of a row.
FOUND = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("route", T.ArrayType(T.StringType())))

#: Fixed patterns and least lengths of the three kinds.
_ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_URL = re.compile(rb"%([0-9A-Fa-f]{2})")
_UNICODE = re.compile(rb"[\\%]u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{%d,}" % RUN)
_BLOCK = re.compile(rb"(?m)^[A-Za-z0-9+/_-]{%d,}\r?(?:\n[A-Za-z0-9+/_-]+\r?)+" % LINE)
_STANDARD = bytes.maketrans(b"-_", b"+/")
_HEADERS = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")


def _marker(members: bytes) -> bytes:
    return bytes(65 if b in members else 32 for b in range(256))


_HEX_MARK = _marker(b"0123456789abcdef")
_BASE64_MARK = _marker(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


@dataclass(frozen=True)
class Layer:
    """Bytes, and for each of them the first and the end of the bytes of the text that it stands for."""

    data: bytes
    lo: np.ndarray
    hi: np.ndarray
    route: tuple[str, ...] = ()


@dataclass(frozen=True)
class Finding:
    kind: str
    start: int
    end: int
    route: tuple[str, ...]


def matches(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the secrets of one layer; cheap searches skip kinds that cannot occur."""
    low = data.lower()
    if any(n in low for n in _NAMES):
        for m in _ASSIGN.finditer(data):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                yield "assign", m.start(), m.end()
    if b"AKIA" in data:
        for m in _ACCESS.finditer(data):
            if m.end() - m.start() >= LEAST["access"]:
                yield "access", m.start(), m.end()
    if b"A" * LEAST["hex"] in data.translate(_HEX_MARK):
        for m in _HEX.finditer(data):
            if m.end() - m.start() >= LEAST["hex"]:
                yield "hex", m.start(), m.end()


def _character(code: int) -> bytes:
    return chr(code).encode("utf-8", "surrogatepass") if code < 0x110000 else b""


def _unicode_bytes(m: re.Match) -> bytes:
    for k in range(1, 7):
        if m[k] is not None:
            return _character(int(m[k], 10 if k == 5 else 16))
    raise AssertionError


def _replaced(layer: Layer, pattern: re.Pattern, name: str, decode) -> Iterator[Layer]:
    """For each line with an escape: the line with its escapes decoded."""
    data, at = layer.data, 0
    while m := pattern.search(data, at):
        begin = data.rfind(b"\n", 0, m.start()) + 1
        stop = data.find(b"\n", m.start())
        at = stop = len(data) if stop < 0 else stop
        parts, edges, last = [], [], begin
        for m in pattern.finditer(data, begin, stop):
            parts += [data[last : m.start()], decode(m)]
            last = m.end()
            edges.append((m.start(), last - 1))
        parts.append(data[last:stop])
        # Places of the new bytes: those of kept bytes run on, those of a decoded escape stand still.
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.array(edges, np.int64)
        kept = np.r_[begin, first[:, 1] + 1]
        lo, hi = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        lo[::2], lo[1::2], hi[::2], hi[1::2] = kept, first[:, 0], kept, first[:, 1]
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        step *= np.repeat(np.arange(len(parts)) % 2 == 0, sizes)
        yield Layer(b"".join(parts), layer.lo[np.repeat(lo, sizes) + step], layer.hi[np.repeat(hi, sizes) + step], (*layer.route, name))


def _has_run(data: bytes) -> bool:
    """Whether ``data`` may hold a run or a block of base64."""
    return b"A" * LINE in data.translate(_BASE64_MARK)


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    data = layer.data
    if not _has_run(data):
        return
    for pattern in (_BASE64, _BLOCK):
        for m in pattern.finditer(data):
            run = np.frombuffer(m[0], np.uint8)
            places = np.flatnonzero((run != 10) & (run != 13)) + m.start()
            letters = m[0].translate(_STANDARD, b"\r\n")
            for skip in range(min(4, len(letters))):
                part = letters[skip:]
                part = part[: len(part) - (len(part) % 4 == 1)]
                new = base64.b64decode(part + b"=" * (-len(part) % 4))
                if new:
                    bits = 8 * np.arange(len(new))
                    yield Layer(new, layer.lo[places[skip + bits // 6]], layer.hi[places[skip + (bits + 7) // 6]], (*layer.route, "base64"))


def _engine(head: bytes):
    if head.startswith(b"\x1f\x8b"):
        return zlib.decompressobj(31)
    if head.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head.startswith(b"\xfd") else zlib.decompressobj(15)


class _TooLong(Exception):
    pass


ENDED = object()


def _inflate(data: bytes, at: int, head: bytes, most: int) -> tuple[bytes, int]:
    """What the stream at ``at`` holds, and where it ends; broken streams give what could be read."""
    engine, view, out, size, feed = _engine(head), memoryview(data), [], 0, b""
    try:
        while not engine.eof:
            if not feed and getattr(engine, "needs_input", True):
                feed = view[at : at + CHUNK]
                at += len(feed)
                if not feed:
                    break
            piece = engine.decompress(feed, CHUNK)
            feed = getattr(engine, "unconsumed_tail", b"")
            size += len(piece)
            if size > most:
                raise _TooLong
            out.append(piece)
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        pass
    return b"".join(out), at - (len(engine.unused_data) if engine.eof else 0)


def _compressed_layers(layer: Layer, most: Callable[[], int]) -> Iterator[Layer | None]:
    """One layer for each compressed stream, None for one that is too long."""
    at = 0
    while m := _HEADERS.search(layer.data, at):
        at = m.start() + 1
        try:
            new, stop = _inflate(layer.data, m.start(), m[0], most())
        except _TooLong:
            yield None
            continue
        if new:
            lo, hi = layer.lo[m.start()], layer.hi[stop - 1]
            yield Layer(new, np.broadcast_to(lo, len(new)), np.broadcast_to(hi, len(new)), (*layer.route, COMPRESSED))


def unwrapped(layer: Layer, most: Callable[[], int]) -> Iterator[Layer | None]:
    """The layers right below ``layer``."""
    data = layer.data
    if b"%" in data:
        yield from _replaced(layer, _URL, "url", lambda m: bytes([int(m[1], 16)]))
    if b"\\" in data or b"&#" in data:
        yield from _replaced(layer, _UNICODE, "unicode", _unicode_bytes)
    yield from _base64_layers(layer)
    yield from _compressed_layers(layer, most)


def search(text: str | None, most: int = MOST, total: int = TOTAL) -> tuple[list[Finding], int]:
    """The findings of a text, by code points, in the order of start, kind and end, and the number of unread layers."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found: dict[tuple[str, int, int], tuple[str, ...]] = {}
    for kind, a, b in matches(data):
        found[kind, a, b] = ()
    room, unread = max(total, 64 * len(data)), 0
    if _wrapped(data):
        places = np.arange(len(data), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        # The worklist: of each layer on the way down, what is still to be unwrapped, so only one branch is in memory.
        work, seen = [unwrapped(Layer(data, places, places + 1), lambda: min(most, room))], {(hashlib.sha256(data).digest(), 0, len(data))}
        while work:
            new = next(work[-1], ENDED)
            if new is ENDED:
                work.pop()
            elif new is None:
                unread += 1
            elif new.data:
                key = (hashlib.sha256(new.data).digest(), int(new.lo[0]), int(new.hi[-1]))
                if key not in seen:
                    seen.add(key)
                    room -= len(new.data) if new.route[-1] == COMPRESSED else 0
                    for kind, a, b in matches(new.data):
                        found.setdefault((kind, int(new.lo[a]), int(new.hi[b - 1])), new.route)
                    work.append(unwrapped(new, lambda: min(most, room)))
    if found and not data.isascii():
        lead = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)]
        found = {(k, int(lead[a]), int(lead[b])): route for (k, a, b), route in found.items()}
    rank = KINDS.index
    return [Finding(k, a, b, found[k, a, b]) for k, a, b in sorted(found, key=lambda f: (f[1], rank(f[0]), f[2]))], unread


def _wrapped(data: bytes) -> bool:
    """Whether anything in ``data`` could be unwrapped."""
    return b"%" in data or b"\\" in data or b"&#" in data or _has_run(data) or _HEADERS.search(data) is not None


def scan(docs: DataFrame, most: int = MOST, total: int = TOTAL) -> DataFrame:
    """doc_id, found (kind, start, end and route of every finding, outermost layer first) and n_unread of every row."""
    rows = docs.select("doc_id", "text")
    schema = rows.select("doc_id").schema.add("found", FOUND).add("n_unread", "long")
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("route", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, unread = [], []
            for text in batch.column(1):
                spans, n = search(text.as_py(), most, total)
                found.append([{"kind": f.kind, "start": f.start, "end": f.end, "route": list(f.route)} for f in spans])
                unread.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind)), pa.array(unread, pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)
