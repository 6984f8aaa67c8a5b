"""Change capture as Structured Streaming: files that change, applied once to the snapshot store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.journal import IDLE_SECONDS
from tessera.session import materialize
from tessera.sources.snapshots import SnapshotStore, delta

CHANGES = "op string, path string, content string"


def prepare_batch(scan: DataFrame, baseline: DataFrame) -> DataFrame | None:
    """Changes (op, path, content) that lead from ``baseline`` (path, sha256) to ``scan``; None if there are none."""
    found = delta(baseline, scan).join(scan.select("path", "content"), "path", "left").select("op", "path", "content")
    return None if found.isEmpty() else found


def change_stream(spark: SparkSession, folder: str, schema: str = f"project_id string, seq long, {CHANGES}") -> DataFrame:
    """Change records that a watcher drops into ``folder`` as JSON files."""
    return spark.readStream.schema(schema).json(folder)


def newest_changes(batch: DataFrame) -> DataFrame:
    """The last change of each path within a micro-batch."""
    last = batch.groupBy("project_id", "path").agg(F.max_by(F.struct("op", "content"), "seq").alias("c"))
    return last.select("project_id", F.col("c.op").alias("op"), "path", F.col("c.content").alias("content"))


def apply_changes(stream: DataFrame, store: SnapshotStore, checkpoint: str) -> StreamingQuery:
    """Apply each micro-batch once, all its projects in one job.

    A batch that runs again after a failure has the same request id. A project whose pointer exists is done; of others
    nothing is visible and they are published; so at-least-once delivery has the effect of exactly once.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        store.apply_batch(f"batch-{batch_id}", materialize(newest_changes(batch), "changes"))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idle_stream(events: DataFrame, key: str, stamp: str, lateness: str = "10 minutes", seconds: int = IDLE_SECONDS) -> DataFrame:
    """Runs of events no more than ``seconds`` apart, closed once the watermark has passed."""
    window = F.session_window(stamp, f"{seconds} seconds")
    return events.withWatermark(stamp, lateness).groupBy(key, window.alias("w")).agg(F.count("*").alias("events"), F.min(stamp).alias("started"), F.max(stamp).alias("ended"))


def overflow_stream(changes: DataFrame, stamp: str, window: str = "150 milliseconds", limit: int = 4096, lateness: str = "1 second") -> DataFrame:
    """Change counts per debounce window and whether they overflow, upon which every project counts as changed."""
    counted = changes.withWatermark(stamp, lateness).groupBy(F.window(stamp, window).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("w", "n", (F.col("n") > limit).alias("overflow"))
