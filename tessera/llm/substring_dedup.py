"""Removal of long repeated byte strings with suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere goes. Equal strings have equal
content-defined anchors (``anchors``), so starts fall into windows, one for each anchor. A window that occurs
twice as a whole is repeated from its first start to its last. The others meet in shards by anchor hash, where
equal strings must be in the same shard whatever documents they are from, and each shard's windows are sorted
by external induced sorting (``suffix``), whose neighbours show the strings that repeat.

The windows of one anchor may be more than a task can sort. Such an anchor is split by content: the bytes that a
string has before its anchor are as many in all equal strings, so starts are cut into cells by that number, and all
strings of a cell share a core of bytes around the anchor. Cells meet by the hash of the core. Anchors that are still
too large are cut into cells of half the size, until the core is the string itself and equal ones are one window.

Windows are told apart by the 128 bits of two hashes; within a shard bytes are compared. Copies of a window are
collapsed within each batch before the shuffle, so a passage of a third of all documents is one row for each
batch. Texts are compressed, numbered and written once; all else is derived from that table.

Null text is empty; texts shorter than the length lose nothing. Rows that repeat a doc_id are texts of their
own. Bytes that are left need not be valid UTF-8, so results carry them as binary. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from tessera.llm.anchors import anchor_place, anchors
from tessera.llm.hashing import row_id
from tessera.llm.suffix import QUEUE_BYTES, repeated
from tessera.session import materialize

LENGTH = 400
#: Bytes of windows that one call of the sorter takes; a shard beyond it goes on in a further call by hash, and an
#: anchor beyond it is split.
SHARD_BYTES = 2 << 20


def windows(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """h, w, rid, s, e, n: anchor hash, window hash, row, first and last start, occurrences in the row.

    A window that the same row holds more than once is given once with its count, and once more with a null
    hash for every run of its starts: these are repeated for certain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, grow = xxhash.xxh3_64_intdigest, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            sure: list[tuple[int, int, int]] = []
            for rid, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = grow(z)
                h, s, e = anchors(data, length)
                if not len(h):
                    continue
                w = np.array([digest(data[a : b + length]) for a, b in zip(s.tolist(), e.tolist(), strict=True)], np.uint64).view(np.int64)
                both = np.empty(len(h), [("h", np.int64), ("w", np.int64)])
                both["h"], both["w"] = h, w
                _, first, count = np.unique(both, return_index=True, return_counts=True)
                if len(first) < len(h):
                    once = np.zeros(len(h), bool)
                    once[first[count == 1]] = True
                    many = np.flatnonzero(~once)
                    for part in np.split(many, np.flatnonzero(np.diff(many) != 1) + 1):
                        sure.append((rid, int(s[part[0]]), int(e[part[-1]])))
                for column, values in zip(out, (h[first], w[first], np.full(len(first), rid), s[first], e[first], count), strict=True):
                    column.append(values)
            flat = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
            if sure:
                more = np.array(sure, np.int64).T
                nulls = np.r_[np.zeros(len(flat[0]), bool), np.ones(len(sure), bool)]
                flat = [np.r_[flat[0], more[0]], np.r_[flat[1], more[0]], np.r_[flat[2], more[0]], np.r_[flat[3], more[1]], np.r_[flat[4], more[2]], np.r_[flat[5], more[0]]]
                yield pa.RecordBatch.from_arrays([pa.array(flat[0], mask=nulls), pa.array(flat[1], mask=nulls), *map(pa.array, flat[2:])], ["h", "w", "rid", "s", "e", "n"])
            else:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, flat)), ["h", "w", "rid", "s", "e", "n"])

    return texts.select("rid", "z").mapInArrow(run, "h long, w long, rid long, s long, e long, n long")


def collapsed(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """h, w, n, rid, s, e, kinds, size: each different window with its occurrences and one place of it.

    size is the number of bytes of the different windows of the anchor.

    Kept are windows that occur twice, or whose anchor other windows have, too.
    """

    names = ["h", "w", "n", "rid", "s", "e"]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by(["h", "w"], use_threads=False)
            one = table.aggregate([("n", "sum"), ("rid", "first"), ("s", "first"), ("e", "first")])
            yield from one.select(["h", "w", "n_sum", "rid_first", "s_first", "e_first"]).rename_columns(names).to_batches()

    each = found.where("h is not null").select(*names).mapInArrow(combine, "h long, w long, n long, rid long, s long, e long").repartition("h")
    one = each.groupBy("h", "w").agg(F.sum("n").alias("n"), F.min(F.struct("rid", "s", "e")).alias("place"))
    same = Window.partitionBy("h")
    size = F.sum(F.col("place.e") - F.col("place.s") + length).over(same)
    return one.select("*", F.count("*").over(same).alias("kinds"), size.alias("size")).where("n > 1 or kinds > 1").select("h", "w", "n", "place.*", "kinds", "size")


def packed(docs: DataFrame) -> DataFrame:
    """rid, doc_id, z: numbered rows with their texts compressed, written once."""
    rows = docs.select(row_id(), "doc_id", "text")
    schema = rows.drop("text").schema.add("z", BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            z = [shrink((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(z, pa.binary())], schema.names)

    return materialize(rows.mapInArrow(run, schema), "string-texts")


def _cut_windows(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """h, rid, s, n, body for each wanted window (rid, h, s, e, n)."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("h", "s", "e", "n")).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for rid, z, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = grow(z)
                rows += [(p["h"], rid, p["s"], p["n"], data[p["s"] : p["e"] + length]) for p in parts]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["h", "rid", "s", "n", "body"])

    return texts.join(lists, "rid").select("rid", "z", "list").mapInArrow(run, "h long, rid long, s long, n long, body binary")


def _cells(cut: DataFrame, length: int, cell: int) -> DataFrame:
    """h, w, rid, s, e, n: the windows of ``cut`` in cells of ``cell`` starts, with h from the core of the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, most = xxhash.xxh3_64_intdigest, length - length // 2
        for batch in batches:
            rows = []
            for rid, s, n, body in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                at = anchor_place(body, length)
                last = len(body) - length
                for c in range((at - last) // cell, at // cell + 1):
                    near, far = c * cell, min((c + 1) * cell - 1, most)
                    a, b = max(0, at - far), min(last, at - near)
                    rows.append((digest(body[at - near : at - far + length], c), digest(body[a : b + length]), rid, s + a, s + b, n))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            hashes = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns[:2]]
            yield pa.RecordBatch.from_arrays(hashes + [pa.array(c, pa.int64()) for c in columns[2:]], ["h", "w", "rid", "s", "e", "n"])

    return cut.select("h", "rid", "s", "n", "body").mapInArrow(run, "h long, w long, rid long, s long, e long, n long")


def _sorted_shards(cut: DataFrame, length: int, limit: int, shard_bytes: int) -> DataFrame:
    """rid, s, e: runs of repeated starts of the windows that occur once as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            out = []
            if rows:
                for (_, rid, s, n, _), again in zip(rows, repeated([r[4] for r in rows], length, limit), strict=True):
                    if n > 1 or not again.any():
                        continue
                    edge = np.diff(np.r_[0, again.astype(np.int8), 0])
                    out += [(rid, s + a, s + b - 1) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rid", "s", "e"])

        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > shard_bytes and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        yield flush(held)

    dealt = cut.repartition("h").sortWithinPartitions("h", "rid", "s")
    return dealt.select("h", "rid", "s", "n", "body").mapInArrow(run, "rid long, s long, e long")


def repeated_starts(texts: DataFrame, length: int = LENGTH, limit: int = QUEUE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """rid, s, e: runs of starts in ``texts`` (of ``packed``) whose strings of ``length`` bytes also start elsewhere."""
    found = materialize(windows(texts, length), "string-windows")
    starts, small = found.where("h is null").select("rid", "s", "e"), None
    cell = length - length // 2 + 1
    while True:
        kept = materialize(collapsed(found, length), "string-collapsed")
        whole = kept.where("n > 1").select("h", "w")
        starts = starts.unionByName(found.where("h is not null").join(whole, ["h", "w"]).select("rid", "s", "e"))
        rest = kept.where((F.col("kinds") > 1) & (F.col("size") <= shard_bytes))
        small = rest if small is None else small.unionByName(rest)
        large = kept.where((F.col("kinds") > 1) & (F.col("size") > shard_bytes))
        if cell == 1 or large.isEmpty():
            break
        cell = -(-cell // 2)
        found = materialize(_cells(_cut_windows(texts, large, length), length, cell), "string-cells")
    return starts.unionByName(_sorted_shards(_cut_windows(texts, small, length), length, limit, shard_bytes))


def remove_repeats(docs: DataFrame, length: int = LENGTH, limit: int = QUEUE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (from, to) and the bytes kept of every row of ``docs``."""
    texts = packed(docs)
    starts = repeated_starts(texts, length, limit, shard_bytes)
    spans = starts.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("starts"))
    met = texts.join(spans, "rid", "left").select("doc_id", "z", "starts")
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("spans", ArrayType(ArrayType(LongType()))).add("kept", BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            size, removed, spans, kept = [], [], [], []
            for z, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = grow(z)
                size.append(len(data))
                gone: list[list[int]] = []
                for a, b in sorted((r["s"], r["e"] + length) for r in ranges or ()):
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(b, gone[-1][1])
                    else:
                        gone.append([a, b])
                edges = [0, *(x for span in gone for x in span), len(data)]
                rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                removed.append(len(data) - len(rest))
                spans.append(gone)
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], schema.names
            )

    return met.mapInArrow(run, schema)
