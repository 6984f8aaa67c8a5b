"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import held_out

#: A label counts for training unless crc32 of its doc_id leaves this remainder.
MOD, REMAINDER = 3, 1


def training_labels(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` rows (doc_id, y), chosen by hash of the id; repeated ids take their highest label.

    A threshold on the hash leaves little more than ``most`` rows before they are ordered.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", MOD, REMAINDER))
    one = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    share = min(1.0, 1.2 * most / max(1, labels.count()) + 1e-6)
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    near = one.where(h < F.lit(int(share * (1 << 30)))) if share < 1.0 else one
    return near.orderBy(h, "doc_id").limit(most)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, y) of the sampled labels' documents.

    The label side has at most ``most`` rows by construction, so it is broadcast and no text is shuffled. Columns of
    ``docs`` other than doc_id and text are not looked at.
    """
    return docs.select("doc_id", "text").join(F.broadcast(training_labels(labels, label, most)), "doc_id").select("text", "y")
