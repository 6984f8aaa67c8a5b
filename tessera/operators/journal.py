"""Folds over event logs: latest states, expiry, output ranges, idle windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDLE_SECONDS = 300
OVERFLOW_EVENTS = 4096


def latest(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The newest state of each key; the aggregation keeps one struct, not a sorted group."""
    state = F.max(F.struct(*order, *columns)).alias("s")
    return events.groupBy(key).agg(state).select(key, *(F.col(f"s.{c}").alias(c) for c in (*order, *columns)))


def newest_per(rows: DataFrame, key: str, order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("place", place).where("place = 1").drop("place")


def expired(rows: DataFrame, in_use: DataFrame, key: str, stamp: str, before: str) -> DataFrame:
    """Rows older than ``before`` that nothing in use refers to."""
    return rows.where(F.col(stamp) < F.lit(before).cast("timestamp")).join(in_use.select(key), key, "left_anti")


def lru_victims(rows: DataFrame, owner: str, used: str, size: str, key: str, budget: float) -> DataFrame:
    """Rows that do not fit when each owner keeps its most recently used ones within ``budget`` of ``size``."""
    order = Window.partitionBy(owner).orderBy(F.desc(used), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("held", F.sum(size).over(order)).where(F.col("held") > budget)


def live_contexts(rows: DataFrame, owner: str, created: str, key: str, now: str, seconds: int = 900, most: int = 128) -> DataFrame:
    """Read contexts that still hold at ``now``: within their fixed lifetime, and the newest ``most`` of their owner."""
    at = F.lit(now).cast("timestamp")
    alive = rows.where((F.col(created) <= at) & (F.col(created) + F.make_interval(secs=F.lit(seconds)) > at))
    place = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(created), F.desc(key)))
    return alive.withColumn("place", place).where(F.col("place") <= most)


def active_first(jobs: DataFrame, active: tuple[str, ...], limit: int) -> DataFrame:
    """Active jobs before others, newest first."""
    return jobs.orderBy(F.when(F.col("state").isin(*active), 0).otherwise(1), F.desc("updated"), "job_id", "seq").limit(limit)


def with_offsets(chunks: DataFrame) -> DataFrame:
    """job_id, seq, start, size, data: the byte offset of each chunk of a log."""
    order = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("size", F.octet_length("data").cast("long")).withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0)))


def read_range(chunks: DataFrame, cursor: int, max_bytes: int) -> DataFrame:
    """job_id, seq, start, data: the bytes from ``cursor`` on, at most ``max_bytes`` of each log.

    Neither end splits a UTF-8 character: a start within one moves on to the next leading byte, an end within one
    goes back to its leading byte. A range within one character is empty.
    """
    placed = with_offsets(chunks)
    end = cursor + max_bytes
    hit = placed.where((F.col("start") < end) & (F.col("start") + F.col("size") > cursor))
    skip = F.greatest(F.lit(0), F.lit(cursor) - F.col("start"))
    take = F.least(F.col("size"), F.lit(end) - F.col("start"))
    raw = F.hex("data")
    continues = lambda n: F.substring(raw, (2 * n + 1).cast("int"), F.lit(1)).isin("8", "9", "A", "B") & (n < F.col("size"))
    for _ in range(3):
        skip = F.when((skip > 0) & continues(skip), skip + 1).otherwise(skip)
        take = F.when((take < F.col("size")) & continues(take), take - 1).otherwise(take)
    part = F.substring(F.col("data"), (skip + 1).cast("int"), F.greatest(F.lit(0), take - skip).cast("int"))
    return hit.select("job_id", "seq", (F.col("start") + skip).alias("start"), part.alias("data")).where(F.octet_length("data") > 0)


def idle_sessions(events: DataFrame, key: str, stamp: str, seconds: int = IDLE_SECONDS) -> DataFrame:
    """key, started, ended, events: runs of events no more than ``seconds`` apart."""
    window = F.session_window(stamp, f"{seconds} seconds")
    found = events.groupBy(key, window.alias("w")).agg(F.count("*").alias("events"), F.min(stamp).alias("started"), F.max(stamp).alias("ended"))
    return found.select(key, "started", "ended", "events")


def dirty_projects(changes: DataFrame, projects: DataFrame, limit: int = OVERFLOW_EVENTS) -> DataFrame:
    """Projects to rebuild after a batch of changes: those named, or all of them when the batch overflows."""
    size = changes.agg((F.count("*") > limit).alias("overflow"))
    named = changes.select("project_id").distinct().withColumn("named", F.lit(True))
    return projects.join(F.broadcast(size), F.lit(True)).join(named, "project_id", "left").where("overflow or named").select("project_id")
