"""Reversible line deduplication: sharded cuckoo filters over exact reference-count tables.

``LineIndex`` holds three tables. ``refs`` has one row for each document and key it holds, ``counts`` the exact
number of references and the owner (smallest doc_id) of each key, ``filters`` one cuckoo filter for each shard
of keys. An insertion asks the filters first: keys they deny are new for certain and are appended, only the
others meet the count table in a join. A deletion lowers counts, finds a new owner where the owner goes, and
takes keys without references out of the filters, so deleting what was inserted restores the former state. An
insertion that outgrows the shards deals the keys to more of them first.

``dedup_lines`` inserts the documents in ``BATCHES`` batches, dealt by hash, so from the second on the filters
decide which keys are joined.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased; the tables hold
128 bits of its SHA-256. Whether a row loses a key depends on its doc_id alone, so rows find their losses by doc_id
and a hash of their text, whatever rows share that hash. Keys shorter than ``MIN_CHARS`` code points are not indexed. Counts combine before the shuffle, so
a line that a third of all documents hold costs one row for each task.

Null or empty text is one empty line. Rows that repeat a doc_id belong to one document, and so do all rows
without doc_id, which own a line only if no document with an id holds it. An empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, StructField, StructType

from tessera.llm.cuckoo import CuckooFilter, build
from tessera.session import materialize

MIN_CHARS = 10
#: Keys that one shard, and so one filter, is sized for.
SHARD_KEYS = 200_000
BATCHES = 2
_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128 bits of the key's SHA-256, or None for a line that is too short to be indexed."""
    key = line.strip(_STRIP).lower()
    if len(key) < min_chars or not (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
        return None
    return hashlib.sha256(key).digest()[:16]


def document_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, th (a hash of the text), key: the distinct keys of every row."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    schema = rows.select("doc_id", "th").schema.add("keys", ArrayType(BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [
                list(dict.fromkeys(k for line in set((t or "").encode("utf-8", "surrogatepass").split(b"\n")) if (k := line_key(line, min_chars))))
                for t in batch.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.binary()))], ["doc_id", "th", "keys"])

    return rows.mapInArrow(run, schema).select("doc_id", "th", F.explode("keys").alias("key"))


def _hash64(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), np.uint64)


def _shard(shards: int) -> F.Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")


def _counted(refs: DataFrame, shards: int) -> DataFrame:
    """shard, key, refs, nulls, lo, hi of the references given."""
    return refs.groupBy(_shard(shards), "key").agg(
        F.count("*").alias("refs"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")
    )


def _merged() -> list[F.Column]:
    return [F.sum("refs").alias("refs"), F.sum("nulls").alias("nulls"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]


@dataclass(frozen=True)
class LineIndex:
    """The state after some insertions and deletions; every operation returns a new state.

    ``refs`` is the union of what insertions have written, until a deletion writes it anew.
    """

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    shard_keys: int = SHARD_KEYS

    @staticmethod
    def create(docs: DataFrame, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, room: int = 1) -> LineIndex:
        """Insert all of ``docs`` into an empty index, whose number of shards suffices for ``room`` times their keys."""
        refs = materialize(document_keys(docs, min_chars), "line-refs")
        shards = max(1, -(-refs.count() * room // shard_keys))
        counts = materialize(_counted(refs, shards), "line-counts")
        return LineIndex(refs, counts, LineIndex._filters(counts, room), shards, min_chars, shard_keys)

    @staticmethod
    def _filters(counts: DataFrame, room: int = 1) -> DataFrame:
        """A filter for each shard, with slots for ``room`` times its keys and a quarter more."""

        def make(df: pd.DataFrame) -> pd.DataFrame:
            made = build(_hash64(df["key"]), spare=len(df) * (room - 1) + len(df) // 4)
            return pd.DataFrame({"shard": [int(df["shard"].iloc[0])], "filter": [made.dump()]})

        return materialize(counts.select("shard", "key").groupBy("shard").applyInPandas(make, "shard int, filter binary"), "line-filters")

    def probe(self, keys: DataFrame) -> DataFrame:
        """``keys`` (shard, key, ...) with ``maybe``: false only if the index does not hold the key."""

        def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            left["maybe"] = CuckooFilter.load(right["filter"].iloc[0]).contains(_hash64(left["key"])) if len(right) else False
            return left

        return keys.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(ask, StructType([*keys.schema.fields, StructField("maybe", BooleanType())]))

    def _updated_filters(self, changes: DataFrame) -> DataFrame:
        """Filters after ``changes`` (shard, key, add): keys that enter or leave the count table."""

        def change(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return right[["shard", "filter"]]
            new, gone = _hash64(left["key"][left["add"]]), _hash64(left["key"][~left["add"]])
            if not len(right):
                return pd.DataFrame({"shard": [int(left["shard"].iloc[0])], "filter": [build(new, spare=len(new) // 4).dump()]})
            now = CuckooFilter.load(right["filter"].iloc[0])
            now.remove(gone)
            full = not now.has_room(len(new)) or len(now.add(new)) > 0
            return pd.DataFrame({"shard": [int(left["shard"].iloc[0])], "filter": [None if full else now.dump()]})

        return changes.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(change, "shard int, filter binary")

    def _next(self, refs: DataFrame, counts: DataFrame, changes: DataFrame) -> LineIndex:
        counts = materialize(counts, "line-counts")
        filters = materialize(self._updated_filters(changes), "line-filters")
        full = filters.where("filter is null").select("shard")
        if not full.isEmpty():
            filters = materialize(filters.where("filter is not null").unionByName(self._filters(counts.join(full, "shard", "left_semi"))), "line-filters")
        return replace(self, refs=refs, counts=counts, filters=filters)

    def _grown(self, refs: int) -> LineIndex:
        """The same state with shards for ``refs`` references, at least twice as many as before if these are too few."""
        if refs <= self.shards * self.shard_keys:
            return self
        shards = max(2 * self.shards, -(-refs // self.shard_keys))
        counts = materialize(self.counts.withColumn("shard", _shard(shards)), "line-counts")
        return replace(self, counts=counts, filters=self._filters(counts), shards=shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents that the index does not hold yet."""
        new = materialize(document_keys(docs, self.min_chars), "line-refs-new")
        return self._grown(self.refs.count() + new.count())._insert(new)

    def _insert(self, new: DataFrame) -> LineIndex:
        probed = materialize(self.probe(_counted(new, self.shards)), "line-probed")
        fresh = probed.where("not maybe").drop("maybe")
        known = probed.where("maybe").drop("maybe")
        met = self.counts.unionByName(known).groupBy("shard", "key").agg(*_merged())
        entered = fresh.select("shard", "key").unionByName(known.join(self.counts, ["shard", "key"], "left_anti").select("shard", "key"))
        return self._next(self.refs.unionByName(new), met.unionByName(fresh), entered.withColumn("add", F.lit(True)))

    def delete(self, ids: DataFrame) -> LineIndex:
        """Take away the documents whose ids are in the column doc_id of ``ids``."""
        ids = ids.select("doc_id").distinct()
        same = self.refs["doc_id"].eqNullSafe(ids["doc_id"])
        gone = materialize(_counted(self.refs.join(ids, same, "left_semi"), self.shards), "line-gone")
        refs = materialize(self.refs.join(ids, same, "left_anti"), "line-refs")
        touched = gone.select("shard", "key")
        again = materialize(_counted(refs.join(touched, "key", "left_semi"), self.shards), "line-again")
        counts = self.counts.join(touched, ["shard", "key"], "left_anti").unionByName(again)
        left = touched.join(again, ["shard", "key"], "left_anti").withColumn("add", F.lit(False))
        return self._next(refs, counts, left)

    def shared(self) -> DataFrame:
        """key, owner: the keys that at least two documents hold."""
        many = (F.col("lo") != F.col("hi")) | ((F.col("nulls") > 0) & F.col("lo").isNotNull())
        return self.counts.where(many).select("key", F.col("lo").alias("owner"))

    def losses(self) -> DataFrame:
        """doc_id, th, keys: the keys each row loses because another document owns them."""
        lost = self.refs.join(self.shared(), "key").where(~F.col("doc_id").eqNullSafe(F.col("owner")))
        return lost.groupBy("doc_id", "th").agg(F.collect_set("key").alias("keys"))


def index_of(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, shard_keys: int = SHARD_KEYS) -> LineIndex:
    """An index of all of ``docs``, inserted in ``batches`` batches."""
    batch = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(batches))
    index = LineIndex.create(docs.where(batch == 0), min_chars, shard_keys, room=batches)
    for k in range(1, batches):
        index = index.insert(docs.where(batch == k))
    return index


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped and the remaining text of every row of ``docs``."""
    losses = index_of(docs, min_chars, batches).losses().withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = rows.join(losses, (rows["th"] == losses["_th"]) & rows["doc_id"].eqNullSafe(losses["_id"]), "left")
    schema = docs.select("doc_id").schema.add("n_lines", "long").add("n_dropped", "long").add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dropped, kept = [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                n.append(len(lines))
                if keys:
                    gone = set(keys)
                    lines = [x for x in lines if line_key(x, min_chars) not in gone]
                dropped.append(n[-1] - len(lines))
                kept.append(b"\n".join(lines).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], schema.names)

    return rows.select("doc_id", "text", "keys").mapInArrow(run, schema)
