"""Fill-in-the-middle: a text is cut at two unit boundaries and its pieces change places.

The kernel takes a whole Arrow batch at once. It reads the offsets and bytes of the batch's UTF-8 buffer, looks up
a class for every byte, marks the bytes at which a unit begins from the classes of adjacent bytes, and takes
running sums of the marks, which each document resets to zero by subtracting the sum at its first byte. A binary
search of those sums places the cuts of all rows together, and one gather writes all outputs. Batches are taken in
slices of about ``SLICE`` bytes, so a worker holds a few times that, or a few times its longest text.

Units are ``line`` (``[^\\n]*\\n|[^\\n]+``), ``word`` (a run of non-space bytes with the white space after it; white
space that opens a text is a unit) or ``char`` (a code point). Where a document is cut, and its form, follow from
SHA-256 of its doc_id, so reruns and retried tasks agree. A prefix or a middle may be empty.

A null text counts as empty. An empty text, and one that holds a sentinel, is left as it is (form ``plain``), so
every output can be turned back into its text: ``restored`` does that. Rows without doc_id are cut by the hash of the
empty id. Rows that repeat a doc_id are cut at the same hashes, each by its own units. An empty table gives an
empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
#: Percentage of texts that change, and of those the percentage in the order suffix, prefix, middle.
RATE, SPM_RATE = 100, 50
#: Bytes of text that one call of the kernel takes.
SLICE = 4 << 20
FORMS = pa.array(["plain", "psm", "spm"])
PLAIN, PSM, SPM = range(3)

#: Classes of bytes: newline, other white space, a byte inside a code point, any other.
_NEWLINE, _SPACE, _INSIDE, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = _SPACE
_CLASS[10] = _NEWLINE
_CLASS[128:192] = _INSIDE


def _boundaries(unit: str) -> np.ndarray:
    """Whether a unit begins at a byte, by 4 * class of the byte before + class of the byte."""
    begins = np.zeros((4, 4), bool)
    if unit == "line":
        begins[_NEWLINE, :] = True
    elif unit == "word":
        for space in (_NEWLINE, _SPACE):
            begins[space, _OTHER] = True
    elif unit == "char":
        begins[:, [_NEWLINE, _SPACE, _OTHER]] = True
    else:
        raise ValueError(f"no unit {unit!r}")
    return begins.ravel()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, starting at zero, and bytes of a string column; null texts have no bytes."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]]


def occurrences(data: np.ndarray, at: np.ndarray, needle: bytes) -> np.ndarray:
    """Places of ``needle`` that do not run over the end of a document, in ascending order."""
    last = len(data) - len(needle) + 1
    if last < 1:
        return np.zeros(0, np.int64)
    found = np.flatnonzero(data[:last] == needle[0])
    for k, byte in enumerate(needle[1:], 1):
        found = found[data[found + k] == byte]
    row = np.searchsorted(at, found, side="right")
    return found[found + len(needle) <= at[row]]


def holders(at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The rows that hold the ``places``."""
    return np.searchsorted(at, places, side="right") - 1


def gather(source: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the rows, and the bytes of all segments (one row of the two arrays for each text) one after another."""
    sizes = length.ravel()
    ends = np.cumsum(sizes)
    shift = np.repeat(begin.ravel() - (ends - sizes), sizes)
    return np.r_[0, ends[length.shape[1] - 1 :: length.shape[1]]], source[np.arange(len(shift)) + shift]


def strings(at: np.ndarray, data: np.ndarray) -> pa.Array:
    if at[-1] >= 1 << 31:
        return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def transform(at: np.ndarray, data: np.ndarray, h: np.ndarray, begins: np.ndarray, rate: int, spm_rate: int, sentinels: tuple[bytes, ...]) -> tuple:
    """Units, form, prefix and middle code points, and offsets and bytes of the outputs, of all rows together.

    ``h`` has four hashes a row: two for the cuts, one for the rate, one for the order.
    """
    cls = _CLASS[data]
    starts = np.zeros(len(data), bool)
    starts[1:] = begins[4 * cls[:-1] + cls[1:]]
    starts[at[:-1][at[:-1] < at[1:]]] = True
    units = np.cumsum(starts, dtype=np.int64)
    chars = np.r_[0, np.cumsum(cls != _INSIDE, dtype=np.int64)]
    before = np.r_[0, units][at]
    base, n = before[:-1], np.diff(before)
    cut = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
    # The first byte whose sum exceeds base + cut opens that unit; after a text's last unit this is the next text.
    places = np.searchsorted(units, base[:, None] + cut, side="right")
    places = np.minimum(places, at[1:, None])
    kept = (at[:-1] == at[1:]) | (h[:, 2] % 100 >= rate)
    for s in sentinels:
        kept[holders(at, occurrences(data, at, s))] = True
    form = np.where(kept, PLAIN, np.where(h[:, 3] % 100 < spm_rate, SPM, PSM))
    first, second, end = places[:, 0], places[:, 1], at[1:]
    mark = len(data) + np.cumsum([0, *map(len, sentinels)])
    source = np.concatenate([data, *(np.frombuffer(s, np.uint8) for s in sentinels)])
    # Segments of a row: mark, piece, mark, piece, mark, piece. Plain rows have one piece, the text.
    spm, whole = form == SPM, form == PLAIN
    p, s = (at[:-1], first - at[:-1]), (second, end - second)
    size = [len(x) for x in sentinels]
    begin = np.column_stack([np.where(spm, mark[1], mark[0]), np.where(spm, s[0], p[0]), np.where(spm, mark[0], mark[1]), np.where(spm, p[0], s[0]), np.full(len(n), mark[2]), first])
    length = np.column_stack([np.where(spm, size[1], size[0]), np.where(spm, s[1], p[1]), np.where(spm, size[0], size[1]), np.where(spm, p[1], s[1]), np.full(len(n), size[2]), second - first])
    length[whole] = 0
    begin[whole, 1], length[whole, 1] = at[:-1][whole], (end - at[:-1])[whole]
    out = gather(source, begin, length)
    counts = chars[places]
    return n, form, counts[:, 0] - chars[at[:-1]], counts[:, 1] - counts[:, 0], *out


def restore(at: np.ndarray, data: np.ndarray, form: np.ndarray, sentinels: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the texts that ``transform`` made into the given outputs, of all rows together."""
    changed = np.flatnonzero(form != PLAIN)
    place = np.zeros((3, len(form)), np.int64)
    for k, s in enumerate(sentinels):
        found = occurrences(data, at, s)
        place[k, holders(at, found)] = found
    p, s, m = place[:, changed]
    sizes = [len(x) for x in sentinels]
    end = at[1:][changed]
    spm = form[changed] == SPM
    begin = np.zeros((len(form), 3), np.int64)
    length = np.zeros((len(form), 3), np.int64)
    begin[:, 0], length[:, 0] = at[:-1], np.diff(at)
    begin[changed] = np.column_stack([p + sizes[0], m + sizes[2], s + sizes[1]])
    length[changed] = np.column_stack([np.where(spm, m, s), end, np.where(spm, p, m)]) - begin[changed]
    return gather(data, begin, length)


def slices(at: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer text is a run of its own."""
    lo, rows = 0, len(at) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def _hashes(seed: int) -> F.Column:
    """The first four 8-digit groups of SHA-256 of seed and doc_id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)))


def fill_middle(
    docs: DataFrame, unit: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS, most: int = SLICE
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null where plain) and output of every row.

    ``sentinels`` open prefix, suffix and middle. They must differ, and none may hold another or begin as another
    ends, so that the pieces of an output can be told apart.
    """
    begins, marks = _boundaries(unit), tuple(s.encode() for s in sentinels)
    _check(marks)
    rows = docs.select("doc_id", "text", _hashes(seed).alias("h"))
    schema = rows.select("doc_id").schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = buffers(batch.column(1))
            h = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            for lo, hi in slices(at, most):
                n, form, prefix, middle, ends, out = transform(at[lo : hi + 1] - at[lo], data[at[lo] : at[hi]], h[lo:hi], begins, rate, spm_rate, marks)
                plain = form == PLAIN
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(n), FORMS.take(pa.array(form)), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), strings(ends, out)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def _check(marks: tuple[bytes, ...]) -> None:
    overlap = any(a != b and any(a.endswith(b[:k]) for k in range(1, len(b) + 1)) or a in b for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j)
    if not all(marks) or overlap or any(m.endswith(m[:k]) for m in marks for k in range(1, len(m))):
        raise ValueError("sentinels must be non-empty and must not overlap")


def restored(outputs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, most: int = SLICE) -> DataFrame:
    """The columns of ``outputs`` with output replaced by restored, the exact text, from output and form alone."""
    marks = tuple(s.encode() for s in sentinels)
    others = [c for c in outputs.columns if c != "output"]
    rows = outputs.select(*others, "output")
    schema = rows.drop("output").schema.add("restored", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = buffers(batch.column(len(others)))
            form = batch.column(others.index("form")).to_pandas().map({"plain": PLAIN, "psm": PSM, "spm": SPM}).to_numpy()
            for lo, hi in slices(at, most):
                text = strings(*restore(at[lo : hi + 1] - at[lo], data[at[lo] : at[hi]], form[lo:hi], marks))
                yield pa.RecordBatch.from_arrays([*batch.select(range(len(others))).slice(lo, hi - lo).columns, text], schema.names)

    return rows.mapInArrow(run, schema)
