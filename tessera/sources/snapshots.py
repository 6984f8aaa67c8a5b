"""Versioned source states: content-addressed blobs, one partition per revision, a pointer written last."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.coverage import multiset_digest


def blobs(files: DataFrame) -> DataFrame:
    """Each different content once."""
    return files.select("sha256", "content", "size").dropDuplicates(["sha256"])


def with_content(files: DataFrame, stored: DataFrame) -> DataFrame:
    return files.join(stored.select("sha256", "content"), "sha256")


def project_counts(projects: DataFrame, files: DataFrame) -> DataFrame:
    """Files per project, empty projects too."""
    return projects.join(files, "project_id", "left").groupBy("project_id").agg(F.count("path").alias("files"))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    if offset < 0 or not 1 <= limit <= 1000:
        raise ValueError("invalid page")
    return rows.orderBy(*order).offset(offset).limit(limit)


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, op, sha256: what turns ``before`` into ``after``; unchanged files are absent."""
    a, b = before.select("path", F.col("sha256").alias("old")), after.select("path", F.col("sha256").alias("new"))
    both = a.join(b, "path", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("path", F.when(F.col("new").isNull(), "delete").otherwise("upsert").alias("op"), F.col("new").alias("sha256"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, status (added, deleted, modified), old and new hash."""
    a, b = before.select("path", F.col("sha256").alias("old_sha256")), after.select("path", F.col("sha256").alias("new_sha256"))
    both = a.join(b, "path", "full").where(~F.col("old_sha256").eqNullSafe(F.col("new_sha256")))
    status = F.when(F.col("old_sha256").isNull(), "added").when(F.col("new_sha256").isNull(), "deleted").otherwise("modified")
    return both.select("path", status.alias("status"), "old_sha256", "new_sha256")


def diff_with_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, status, moved_from: ``diff`` in which a content deleted once and added once elsewhere has moved."""
    changes = diff(before, after)
    gone = changes.where("status = 'deleted'").groupBy(F.col("old_sha256").alias("sha256")).agg(F.count("*").alias("n"), F.min("path").alias("moved_from"))
    new = changes.where("status = 'added'").groupBy(F.col("new_sha256").alias("sha256")).agg(F.count("*").alias("m"), F.min("path").alias("path"))
    moves = gone.join(new, "sha256").where("n = 1 and m = 1").select("path", "moved_from")
    rest = changes.join(moves, "path", "left").join(moves.select(F.col("moved_from").alias("_from")), changes["path"] == F.col("_from"), "left_anti")
    return rest.select("path", F.when(F.col("moved_from").isNotNull(), "moved").otherwise(F.col("status")).alias("status"), "moved_from")


def page_with_total(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page with ``total``, ``has_more`` and ``next_offset`` on every row; the total is one row, so it is broadcast."""
    total = rows.agg(F.count("*").alias("total"))
    shown = page(rows, order, offset, limit).join(F.broadcast(total), F.lit(True))
    more = F.col("total") > offset + limit
    return shown.withColumn("has_more", more).withColumn("next_offset", F.when(more, F.lit(offset + limit).cast("long")))


def diff_totals(changes: DataFrame) -> DataFrame:
    return changes.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("added", "deleted", "modified")))


def retained(revisions: DataFrame, keep: int = 2) -> DataFrame:
    """The newest ``keep`` revisions of each project."""
    place = F.dense_rank().over(Window.partitionBy("project_id").orderBy(F.desc("revision")))
    return revisions.withColumn("place", place).where(F.col("place") <= keep).drop("place")


def previous_revision(revisions: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("revision")))
    return revisions.withColumn("place", place).where("place = 2").drop("place")


def orphans(stored: DataFrame, files: DataFrame) -> DataFrame:
    """Blobs that no retained file refers to."""
    return stored.join(files.select("sha256"), "sha256", "left_anti")


class Overtaken(RuntimeError):
    """Another writer published the revision first; what was prepared is not visible and can be prepared anew."""


@dataclass(frozen=True)
class Prepared:
    """A revision whose data is written and whose pointer is not."""

    project_id: str
    revision: int
    row: dict


@dataclass(frozen=True)
class SnapshotStore:
    """Blobs, file lists and pointers below ``root``.

    A file list is cut into ``buckets`` by hash of the path. A revision writes the buckets that its changes touch and
    refers to the folders of all others, so a small change to a large project writes little. Blobs lie in folders by
    the beginning of their hash, and a publication looks only into those it may add to.

    A pointer is one small file for each project and revision, which names the folders of the buckets, the request and
    its payload. It is put in place by a rename that fails if the name is taken. That makes the revision and the
    request known, so a stop at any earlier point leaves files that nobody reads, and of two writers that prepared
    the same revision one is refused.
    """

    spark: SparkSession
    root: str
    buckets: int = 64

    POINTERS = "project_id string, revision long, snapshot string, request_id string, payload_hash string, folders map<string,string>, created_at timestamp"
    FILES = "path string, sha256 string, size long"
    BLOBS = "sha256 string, content string, size long"

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _found(self, pattern: str) -> list[str]:
        """Existing paths below the root that match, relative to it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        status = self._fs().globStatus(path(f"{self.root}/{pattern}"))
        depth = pattern.count("/") + 1
        return ["/".join(str(x.getPath().toString()).split("/")[-depth:]) for x in (status or [])]

    def _pointers(self, pattern: str) -> DataFrame:
        if not self._found(pattern):
            return self.spark.createDataFrame([], self.POINTERS)
        return self.spark.read.schema(self.POINTERS).json(f"{self.root}/{pattern}")

    def pointers(self, project_id: str | None = None) -> DataFrame:
        return self._pointers(f"pointers/{'*' if project_id is None else _key(project_id)}/*.json")

    def _pointer(self, project_id: str, revision: int) -> Row | None:
        return self._pointers(f"pointers/{_key(project_id)}/{revision:012d}.json").first() if revision else None

    def files(self, project_id: str, revision: int) -> DataFrame:
        found = self._pointer(project_id, revision)
        if found is None or not found["folders"]:
            return self.spark.createDataFrame([], self.FILES)
        return self.spark.read.schema(self.FILES).parquet(*(f"{self.root}/{folder}" for folder in found["folders"].values()))

    def blobs(self) -> DataFrame:
        """Each content once, though an interrupted publication may have written it before."""
        if not self._found("blobs"):
            return self.spark.createDataFrame([], self.BLOBS)
        return self.spark.read.schema(f"{self.BLOBS}, head string").parquet(f"{self.root}/blobs").drop("head").dropDuplicates(["sha256"])

    def revision(self, project_id: str, snapshot: str | None = None) -> int:
        """The newest revision, or that of a handle; an unknown handle is an error, never a fallback."""
        if snapshot is not None:
            found = self.pointers(project_id).where(F.col("snapshot") == snapshot).select("revision").collect()
            if not found:
                raise KeyError("unknown snapshot")
            return found[0][0]
        return max((int(name.rsplit("/", 1)[-1].removesuffix(".json")) for name in self._found(f"pointers/{_key(project_id)}/*.json")), default=0)

    def published(self, project_id: str, request_id: str) -> Row | None:
        """The pointer row of a request, if it has been published."""
        return self.pointers(project_id).where((F.col("project_id") == project_id) & (F.col("request_id") == request_id)).first()

    def apply(self, project_id: str, request_id: str, base_revision: int, mode: str, changes: DataFrame) -> int:
        """Publish ``changes`` (op, path, content) once.

        The same request and payload give the same revision again; another payload is an error. The base must
        be the current revision; the first state must be full and later ones deltas; paths must be unique.
        """
        ready = self.prepare(project_id, request_id, base_revision, mode, changes)
        return ready.revision if ready.row is None else self.commit(ready)

    def prepare(self, project_id: str, request_id: str, base_revision: int, mode: str, changes: DataFrame) -> Prepared:
        """Check and write all but the pointer; a request that is published already has no row to commit."""
        hashed = _hashed(changes.select(F.lit(project_id).alias("project_id"), "op", "path", "content"))
        digest = multiset_digest(hashed, F.concat_ws("\0", "op", "path", "sha256")).first()[0]
        payload = f"{mode}:{base_revision}:{digest}"
        seen = self.published(project_id, request_id)
        if seen:
            if seen["payload_hash"] != payload:
                raise ValueError("request id was used for another payload")
            return Prepared(project_id, seen["revision"], None)
        now = self.revision(project_id)
        if base_revision != now:
            raise ValueError(f"base revision {base_revision} is not the current {now}")
        if (mode == "full") != (now == 0):
            raise ValueError("the first state must be full, later ones deltas")
        if not hashed.groupBy("path").count().where("count > 1").isEmpty():
            raise ValueError("a path occurs more than once")
        return self._write(hashed, {project_id: now}, request_id, {project_id: payload})[0]

    def apply_batch(self, request_id: str, changes: DataFrame) -> dict[str, int]:
        """Publish ``changes`` (project_id, op, path, content; a path once in its project) of all projects in one job, on
        whatever revision each has; projects that have published the request are left as they are. Returns the revisions."""
        names = [r[0] for r in changes.select("project_id").distinct().orderBy("project_id").collect()]
        seen = {p: self.published(p, request_id) for p in names}
        done = {p: row["revision"] for p, row in seen.items() if row}
        bases = {p: self.revision(p) for p in names if p not in done}
        if bases:
            open_ = _hashed(changes.where(F.col("project_id").isin(*bases)))
            done |= {x.project_id: self.commit(x) for x in self._write(open_, bases, request_id, dict.fromkeys(bases, "batch"))}
        return done

    def _write(self, hashed: DataFrame, bases: dict[str, int], request_id: str, payloads: dict[str, str]) -> list[Prepared]:
        rows = hashed.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")).withColumn("head", F.substring("sha256", 1, 2))
        new = rows.where("op = 'upsert'")
        heads = [r[0] for r in new.select("head").distinct().collect()]
        stored = self.spark.createDataFrame([], "sha256 string")
        if heads and self._found("blobs"):
            stored = self.spark.read.schema(f"{self.BLOBS}, head string").parquet(f"{self.root}/blobs").where(F.col("head").isin(*heads)).select("sha256")
        fresh = new.select("sha256", "content", "size", "head").dropDuplicates(["sha256"]).join(stored, "sha256", "left_anti")
        fresh.write.mode("append").partitionBy("head").parquet(f"{self.root}/blobs")

        touched: dict[str, set[int]] = {}
        for r in rows.select("project_id", "bucket").distinct().collect():
            touched.setdefault(r["project_id"], set()).add(r["bucket"])
        before = {p: {int(b): f for b, f in row["folders"].items()} if (row := self._pointer(p, now)) else {} for p, now in bases.items()}
        state = new.select("project_id", "bucket", "path", "sha256", "size")
        old = [(p, b, f"{self.root}/{before[p][b]}") for p, bs in touched.items() for b in sorted(bs) if b in before[p]]
        if old:
            kept = self.spark.read.schema(f"project_id string, bucket int, {self.FILES}").parquet(*(path for *_, path in old))
            state = state.unionByName(kept.join(rows.select("project_id", "path"), ["project_id", "path"], "left_anti").select(*state.columns))
        place = f"files/{uuid.uuid4().hex}"
        folders = state.withColumns({"key": F.substring(F.sha2("project_id", 256), 1, 32), "part": F.col("bucket")})
        folders.repartition("project_id", "bucket").write.partitionBy("key", "part").parquet(f"{self.root}/{place}")
        written = set(self._found(f"{place}/key=*/part=*"))
        out = []
        for p, now in bases.items():
            mine = {b: f"{place}/key={_key(p)}/part={b}" for b in touched.get(p, ())}
            kept_folders = {b: f for b, f in before[p].items() if b not in mine}
            named = kept_folders | {b: f for b, f in mine.items() if f in written}
            row = {"project_id": p, "revision": now + 1, "snapshot": f"ctx_{uuid.uuid4().hex}", "request_id": request_id, "payload_hash": payloads[p], "folders": named}
            out.append(Prepared(p, now + 1, row))
        return out

    def commit(self, ready: Prepared) -> int:
        """Put the pointer in place, or raise ``Overtaken`` if the revision has one."""
        fs, jvm = self._fs(), self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        folder = f"{self.root}/pointers/{_key(ready.project_id)}"
        final, draft = path(f"{folder}/{ready.revision:012d}.json"), path(f"{folder}/.draft-{uuid.uuid4().hex}")
        row = {**ready.row, "folders": {str(b): f for b, f in ready.row["folders"].items()}, "created_at": datetime.now(UTC).isoformat()}
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()
        # FileContext's rename without options refuses to replace, on every file system.
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        none[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), none)
        except Exception as error:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Overtaken(f"revision {ready.revision} of {ready.project_id} was published by another writer") from error
            raise
        return ready.revision


def _key(project_id: str) -> str:
    """A project's folder name."""
    return hashlib.sha256(project_id.encode()).hexdigest()[:32]


def _hashed(changes: DataFrame) -> DataFrame:
    return changes.select("project_id", "op", "path", F.sha2("content", 256).alias("sha256"), "content", F.octet_length("content").cast("long").alias("size"))
