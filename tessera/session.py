"""Session helpers: tables that cut lineage, and broadcasts behind a size check."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The group that tables written now belong to, and the tables of each group of each application.
_group: ContextVar[tuple[str, str] | None] = ContextVar("group", default=None)
_groups: dict[tuple[str, str], list[str]] = {}

#: Rows up to which a side may be broadcast; beyond it the join shuffles both sides.
BROADCAST_ROWS = 200_000


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Where neither is set, a local master gets a folder of its own under /tmp, which is set for the context; on a
    cluster the warehouse is shared by definition, unless it is on the driver's own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(f"file:///tmp/checkpoints/tessera-{uuid.uuid4().hex}")
        return context._jsc.sc().getCheckpointDir().get().rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if "://" not in warehouse:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse.rstrip('/')}/tessera-work"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    What follows starts from files that outlive any executor, and is computed from one fixed state. The files
    are marked for deletion when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if _group.get() is not None:
        _groups[_group.get()].append(path)
    writer.parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def working(spark: SparkSession, group: str) -> Iterator[None]:
    """Tables that ``materialize`` writes inside belong to ``group``, whose earlier tables are deleted first.

    For steps whose results are written and read again before the next step of the group begins: what a step needed on
    the way is gone when the next one starts, instead of at the end of the session.
    """
    key = (spark.sparkContext.applicationId, group)
    for path in _groups.pop(key, []):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    _groups[key] = []
    token = _group.set(key)
    try:
        yield
    finally:
        _group.reset(token)


def maybe_broadcast(small: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if its counted ``rows`` stay within ``limit``, else unchanged."""
    return F.broadcast(small) if rows <= limit else small
