"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, scaled by its quality weight: ``-ln(u) / weight`` with u from a hash of
id and text, so reruns agree and good documents come early. Within its source the documents stand in the order
of their keys; a source first takes as many complete epochs as its target allows and then the prefix of that
order whose sizes sum to the rest, the last document in part.

Prefix sums over a source of any size take two levels: keys fall into ``BUCKETS`` ordered buckets, whose sums
are prefix-summed (at most ``BUCKETS`` rows a source); only the one bucket in which the budget ends is sorted
by key. Targets are computed on one row for each source.

Null text has size 0; the null source is a source and comes last; sources of size 0 get target 0. Repeated rows
take part one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tessera.llm.hashing import numbered, row_id
from tessera.session import materialize, maybe_broadcast

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BUCKETS = 4096
SEED = 6


def quality_weight(words: list[bytes]) -> float:
    """Between 0.25 and 1: texts that repeat few words weigh most."""
    return 0.25 + 0.75 * (len(set(words)) / len(words)) if words else 1.0


def drawn(docs: DataFrame, seed: int = SEED, buckets: int = BUCKETS, rid: str | None = None) -> DataFrame:
    """rid, doc_id, source, size, key, bucket for every row."""
    rows = docs.select(row_id(rid), "doc_id", "source", "text")
    schema = rows.drop("text").schema.add("size", "long").add("key", "double").add("bucket", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, weight, h = [], [], []
            for i, text in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                words = data.split()
                size.append(len(words))
                weight.append(quality_weight(words))
                h.append(xxhash.xxh64_intdigest(f"{i}", xxhash.xxh64_intdigest(data, seed)))
            u = ((np.array(h, np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            key = -np.log(u) / np.array(weight, np.float64)
            bucket = np.minimum(buckets - 1, (buckets * -np.expm1(-key)).astype(np.int64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int64()), pa.array(key), pa.array(bucket)], schema.names)

    return rows.mapInArrow(run, schema)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Weights repeat along the sources in code-point order. Sharing by weight with a ceiling, and sharing the
    excess again until none is above, ends at target = min(ceiling, level * weight); the level is found on the
    sources sorted by ceiling / weight, where those at their ceiling come first.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("r", F.col("cap") / F.col("w"))
    order = Window.orderBy("r", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    levelled = (
        weighed.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("at", F.when(F.col("level") <= F.col("r"), F.struct(F.row_number().over(order).alias("n"), "level")))
        .withColumn("level", F.min("at").over(everything)["level"])
    )
    return levelled.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def budgets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """One row a source: source_size, target, epochs, and where the fractional epoch ends (cut, room)."""
    cells = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "mix-buckets")
    plan = targets(cells.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    goal = F.round("target").cast("long")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)))
    plan = materialize(plan.withColumn("rest", goal - F.col("epochs") * F.col("source_size")), "mix-plan")
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
    named = plan.select(F.col("source").alias("_source"), "rest")
    ends = cells.withColumn("upto", upto).join(named, cells["source"].eqNullSafe(named["_source"]))
    ends = ends.where((F.col("rest") > 0) & (F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
    ends = ends.select("_source", F.col("bucket").alias("cut"), (F.col("rest") - F.col("upto") + F.col("n")).alias("room"))
    return materialize(plan.join(ends, plan["source"].eqNullSafe(ends["_source"]), "left").drop("_source", "rest"), "mix-budgets")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS, seed: int = SEED, rid: str | None = None) -> DataFrame:
    """rid, doc_id, source, size, source_size, target, epochs, part and taken for every row.

    A row is taken ``epochs`` times whole, and then its first ``part`` words.
    """
    rows = materialize(drawn(docs, seed, rid=rid), "mix-keys")
    plan = budgets(rows, weights, most)
    named = maybe_broadcast(plan.withColumnRenamed("source", "_source"), plan.count())
    met = rows.join(named, rows["source"].eqNullSafe(named["_source"]))
    whole = met.where(F.col("cut").isNull() | (F.col("bucket") != F.col("cut"))).withColumn("part", F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    split = met.where(F.col("bucket") == F.col("cut")).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - before)))
    both = whole.unionByName(split)
    return both.select("rid", "doc_id", "source", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each row as often as it is taken, a row taken in part cut after its words.

    A cut text has its white space folded to single spaces, and n_chars (if present) set anew.
    """
    own = docs.columns
    rows = numbered(docs, F.struct(*own).alias("row"))
    taken = mix(rows.select("rid", "row.doc_id", "row.source", "row.text"), weights, most, seed, rid="rid").where("taken > 0").select("rid", "size", "epochs", "part")
    met = rows.join(taken, "rid")
    met = met.select("row", "size", F.explode(F.concat(F.array_repeat(F.col("size"), F.col("epochs").cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))).alias("words"))
    text = F.col("row")["text"]
    cut = F.array_join(F.slice(F.split(F.regexp_replace(text, "^[\\x20\\x09-\\x0D]+", ""), "[\\x20\\x09-\\x0D]+"), F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") == F.col("size"), text).otherwise(cut)
    out = met.withColumn("text", text)
    return out.select(*(F.col("text") if c == "text" else F.when(F.col("words") == F.col("size"), F.col("row")[c]).otherwise(F.char_length("text")).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in own))
