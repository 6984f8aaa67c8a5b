"""The greedy byte budget: files in order of path are admitted while they fit, one that does not is passed over.

What a file may do depends on all before it, so the plain rule is a serial pass. Here a chunk of files is summed up
as a function of the room left when it begins: rooms fall into intervals within which the same files are admitted, and
use the same number of bytes. One pass over the files computes the functions of all chunks side by side, one streaming
pass over the chunks, a thousandth as many, applies them in order and gives each chunk its room, and a last pass
over the files admits them chunk by chunk. All passes hold one chunk at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

#: Total parsed bytes of a project.
PARSE_BUDGET = 32 * 1024 * 1024
#: Files in a chunk, and intervals of a chunk's function; a chunk ends early where its function needs more.
CHUNK, INTERVALS = 1024, 2048


class Room:
    """Bytes that a list of sizes uses, by the room it finds: ``used[i]`` for rooms from ``starts[i]`` on."""

    def __init__(self, budget: int) -> None:
        self.starts, self.used, self.end = np.zeros(1, np.int64), np.zeros(1, np.int64), budget + 1

    def add(self, size: int) -> None:
        ends = np.append(self.starts[1:], self.end)
        cut = self.used + size
        split = (cut > self.starts) & (cut < ends)
        starts = np.concatenate([self.starts, cut[split]])
        used = np.concatenate([self.used + np.where(cut <= self.starts, size, 0), cut[split]])
        order = np.argsort(starts, kind="stable")
        starts, used = starts[order], used[order]
        new = np.r_[True, used[1:] != used[:-1]]
        self.starts, self.used = starts[new], used[new]

    def at(self, room: int) -> int:
        return int(self.used[np.searchsorted(self.starts, room, side="right") - 1])


def greedy(sizes: list[int], room: int) -> list[bool]:
    """The serial rule."""
    out = []
    for s in sizes:
        out.append(s <= room)
        room -= s if out[-1] else 0
    return out


def admit(files: DataFrame, budget: int = PARSE_BUDGET, key: str = "project_id", order: str = "path", size: str = "size", chunk: int = CHUNK, intervals: int = INTERVALS) -> DataFrame:
    """``files`` with ``admitted``, for each ``key`` on its own, in the order of the column ``order``, which must be unique there.

    A size that is null or negative counts as 0. Only key, order and size travel; a key that holds most of the files
    is spread over all tasks but for the pass over its chunks.
    """
    own = files.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(order).alias("o"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("s"))
    ordered = own.repartitionByRange("k", "o").sortWithinPartitions("k", "o").withColumn("part", F.spark_partition_id())
    ordered = materialize(_chunked(ordered, budget, chunk, intervals), "budget-files")
    chunks = ordered.where("starts is not null").select("k", "part", "chunk", "starts", "used")
    rooms = materialize(_rooms(chunks, budget), "budget-rooms")
    told = ordered.select("k", "o", "s", "part", "chunk").join(rooms, ["k", "part", "chunk"])
    told = told.repartition("k", "part", "chunk").sortWithinPartitions("k", "part", "chunk", "o")
    schema = told.select("k", "o").schema.add("admitted", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, room = None, 0
        for batch in batches:
            out = []
            for place, s, entry in zip(zip(*(batch.column(c).to_pylist() for c in ("k", "part", "chunk")), strict=True), batch.column("s").to_pylist(), batch.column("room").to_pylist(), strict=True):
                if place != at:
                    at, room = place, entry
                out.append(s <= room)
                room -= s if out[-1] else 0
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("o"), pa.array(out, pa.bool_())], schema.names)

    verdicts = told.mapInArrow(run, schema)
    met = [F.coalesce(files[key].cast("string"), F.lit("")) == verdicts["k"], files[order].eqNullSafe(verdicts["o"])]
    return files.join(verdicts, met, "left").drop("k", "o")


def _chunked(ordered: DataFrame, budget: int, most: int, intervals: int) -> DataFrame:
    """Rows k, o, s, part with their ``chunk``; the last row of a chunk carries its function, starts and used."""
    schema = ordered.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("chunk", "long"), ("starts", "array<long>"), ("used", "array<long>")))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chunk, n, room, held = None, -1, 0, None, None

        def closed() -> dict:
            return {**held, "starts": room.starts.tolist(), "used": room.used.tolist()}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held is not None:
                    ends = row["k"] != key or n == most or len(room.starts) > intervals
                    out.append(closed() if ends else {**held, "starts": None, "used": None})
                    if ends:
                        room = None
                if room is None:
                    key, chunk, n, room = row["k"], chunk + 1, 0, Room(budget)
                room.add(row["s"])
                n += 1
                held = {**row, "chunk": chunk}
            yield pa.RecordBatch.from_pylist(out, _arrow(batch.schema))
        if held is not None:
            yield pa.RecordBatch.from_pylist([closed()], _arrow(batch.schema))

    def _arrow(given: pa.Schema) -> pa.Schema:
        return pa.schema([*given, ("chunk", pa.int64()), ("starts", pa.list_(pa.int64())), ("used", pa.list_(pa.int64()))])

    return ordered.mapInArrow(run, schema)


def _rooms(chunks: DataFrame, budget: int) -> DataFrame:
    """k, part, chunk, room: what is left of the budget when each chunk begins. Chunks of a key pass one by one."""
    dealt = chunks.repartition("k").sortWithinPartitions("k", "part", "chunk")
    schema = chunks.select("k", "part", "chunk").schema.add("room", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, room = None, budget
        for batch in batches:
            out = []
            for k, starts, used in zip(batch.column("k").to_pylist(), batch.column("starts"), batch.column("used"), strict=True):
                if k != key:
                    key, room = k, budget
                out.append(room)
                at = np.searchsorted(starts.values.to_numpy(), room, side="right") - 1
                room -= used.values[int(at)].as_py()
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("part"), batch.column("chunk"), pa.array(out, pa.int64())], schema.names)

    return dealt.mapInArrow(run, schema)
