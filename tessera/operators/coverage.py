"""Index coverage: histograms, ratios, interleaved samples, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("files"))


def diagnostic_codes(indexed: DataFrame) -> DataFrame:
    """code, files: each code once for a file."""
    return indexed.select("path", F.explode(F.array_distinct(F.transform("diagnostics", lambda d: d["code"]))).alias("code")).groupBy("code").agg(F.count("*").alias("files"))


def category(status: Column) -> Column:
    return F.when(status.isNull(), "unindexed").when(status == "ready", "ready").otherwise("limited")


def coverage(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """known, ready, limited, unindexed over all files; files the index lacks count as unindexed."""
    met = files.select("path").join(indexed.select("path", "status"), "path", "left")
    kinds = category(F.col("status"))
    return met.agg(F.count("*").alias("known"), *(F.count_if(kinds == k).alias(k) for k in ("ready", "limited", "unindexed")))


def interleaved_sample(files: DataFrame, indexed: DataFrame, limit: int = 12) -> DataFrame:
    """Examples in turns from each category, by path."""
    met = files.select("path").join(indexed.select("path", "status"), "path", "left").select("path", category(F.col("status")).alias("category"))
    turn = F.row_number().over(Window.partitionBy("category").orderBy("path"))
    ranked = met.withColumn("turn", turn).where(F.col("turn") <= limit)
    place = F.when(F.col("category") == "ready", 0).when(F.col("category") == "limited", 1).otherwise(2)
    return ranked.orderBy("turn", place).limit(limit)


def multiset_digest(rows: DataFrame, item: Column) -> DataFrame:
    """One digest over the texts ``item`` of all rows, whatever their order.

    The SHA-256 of each item is cut into four numbers, which are summed; so each task sends one row, however many
    rows there are, and repeated rows count.
    """
    hashed = rows.select(F.sha2(item, 256).alias("d"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("d", 1 + 16 * k, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return hashed.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256).alias("digest"))


def inventory_digest(files: DataFrame) -> DataFrame:
    """One digest over (path, sha256) of all files."""
    return multiset_digest(files, F.concat_ws("\0", "path", "sha256"))


def diagnostic_summary(rows: DataFrame) -> DataFrame:
    """category, n, conclusion of value-flow diagnostics."""
    counts = rows.groupBy("category").agg(F.count("*").alias("n"))
    conclusion = F.when(F.col("category") == "limit", "incomplete").when(F.col("category") == "unknown", "possible flows missing").otherwise("static evidence")
    return counts.withColumn("conclusion", conclusion)
