"""Centroid clustering of vectors in exact integer arithmetic, screened by block norms.

Every component x becomes floor(``SCALE`` * x). A vector and a centroid are compressed block by block: of each block of
``BLOCK`` components only its sum, divided by the root of the block's length, and the norm of what is left after
the mean is taken off. By Cauchy-Schwarz the squared distance of two blocks is at least the squared difference of
the first plus the squared difference of the second, so one small product bounds the distances of a vector to all
centroids from below. The centroid with the lowest bound gets its exact integer distance; after that only
centroids whose bound does not exceed it do. Bounds are lowered by more than floating point can be wrong, so
no nearest centroid, and no tie, is screened out. ``checked`` counts the exact distances a vector took.

The integers and compressed vectors are computed once and written; each round reads them, and every task sends one
row of sums for each centroid, however many vectors it holds, so a centroid that takes most of the table costs no
more than another. Centroids (``k`` times the dimension, both parameters) are all that reaches the driver.

Rows whose vector is null, of another length, or holds a null or a non-finite component are not clustered and not
returned. Integers beyond ``LARGEST`` in size stand at that bound, so that squared distances fit 64 bits. Repeated rows
count each; rows without vec_id hash as the empty id; of equal hashes the smaller vec_id and vector come first. With
fewer than k rows there are as many centroids as rows. An empty table gives an empty result. Columns other than
vec_id and the vector are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

DIMENSION, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
BLOCK = 8
LARGEST = 1 << 27
#: Vectors of one call, and pairs of vector and centroid whose differences are held at once.
ROWS, PAIRS = 4096, 1 << 16


def integers(column: pa.Array, dimension: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that can be clustered, and their integers, one row each."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(lengths == dimension)
    values = column.take(pa.array(whole)).flatten()
    x = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimension)
    # A null component comes out as NaN.
    sound = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        q = np.clip(np.floor(scale * x[sound]), -LARGEST, LARGEST)
    return whole[sound], q.astype(np.int64)


def compress(q: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Per block: sum over the root of its length, then the norm of the rest."""
    at = np.arange(0, q.shape[1], block)
    sizes = np.diff(np.r_[at, q.shape[1]])
    sums = np.add.reduceat(q, at, axis=1).astype(np.float64)
    mean = sums / np.sqrt(sizes)
    rest = q - np.repeat(sums / sizes, sizes, axis=1)
    return np.hstack([mean, np.sqrt(np.add.reduceat(rest * rest, at, axis=1))])


def nearest(q: np.ndarray, z: np.ndarray, centroids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: smallest), squared distance and exact distances taken, for each row."""
    c = compress(centroids, block)
    zz, cc = (z * z).sum(axis=1)[:, None], (c * c).sum(axis=1)
    bound = zz + cc - 2 * (z @ c.T)
    bound -= 1e-9 * (zz + cc) + 1
    first = bound.argmin(axis=1)
    diff = q - centroids[first]
    best = np.einsum("ij,ij->i", diff, diff)
    open_ = bound <= best[:, None]
    checked = open_.sum(axis=1)
    row, col = np.nonzero(open_)
    exact = np.empty(len(row), np.int64)
    for lo in range(0, len(row), PAIRS):
        diff = q[row[lo : lo + PAIRS]] - centroids[col[lo : lo + PAIRS]]
        exact[lo : lo + PAIRS] = np.einsum("ij,ij->i", diff, diff)
    # Pairs come in the order of rows, then centroids: the first of a row that has its least distance wins.
    begin = np.r_[0, np.cumsum(checked)[:-1]]
    least = np.minimum.reduceat(exact, begin)
    hit = np.flatnonzero(exact == np.repeat(least, checked))
    winner = hit[np.searchsorted(hit, begin)]
    return col[winner], least, checked


def prepare(vectors: DataFrame, column: str, dimension: int, scale: float, seed: int, block: int) -> DataFrame:
    """vec_id, place (hash that orders the rows), q and z: the integers and the compressed vector as bytes; written once."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select("vec_id", place.alias("place"), F.col(column).cast("array<double>").alias("v"))
    schema = rows.drop("v").schema.add("q", "binary").add("z", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, q = integers(batch.column(2), dimension, scale)
            z = compress(q, block) if len(q) else np.zeros((0, 1))
            packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (q.astype("<i4"), z.astype("<f8"))]
            yield pa.RecordBatch.from_arrays([*batch.select([0, 1]).take(pa.array(at)).columns, *packed], schema.names)

    return materialize(rows.mapInArrow(run, schema), "vectors")


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    rows = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1) if rows else np.zeros((0, 1))


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, block: int) -> Iterator[tuple]:
    """(batch of at most ROWS rows, integers, centroid numbers, distances, exact distances taken); q and z are its last columns."""
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            q = _matrix(batch.column("q"), "<i4").astype(np.int64)
            yield batch, q, *nearest(q, _matrix(batch.column("z"), "<f8"), centroids, block)


def moved(ready: DataFrame, centroids: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The centroids after one round: exact floors of the means; a centroid without vectors stays."""
    k, dimension = centroids.shape
    schema = "cluster int, n long, sums array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dimension), np.int64)
        for _, q, cluster, _, _ in _assigned(batches, centroids, block):
            n += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            held, at = np.unique(cluster[order], return_index=True)
            sums[held] += np.add.reduceat(q[order], at, axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = ready.select("q", "z").mapInArrow(run, schema)
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dimension)))
    after = centroids.copy()
    for r in total.collect():
        after[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dimension)]
    return after


def first_centroids(ready: DataFrame, k: int) -> np.ndarray:
    """The integers of the ``k`` rows with the smallest hashes, in that order."""
    rows = ready.orderBy("place", "vec_id", "q").limit(k).select("q").collect()
    return np.array([np.frombuffer(r["q"], "<i4") for r in rows], np.int64)


def cluster(
    vectors: DataFrame, column: str = "embedding", dimension: int = DIMENSION, scale: float = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, block: int = BLOCK
) -> DataFrame:
    """vec_id, cluster, distance, checked, cluster_inertia, inertia and centroid (its integers) of every clustered row."""
    spark = vectors.sparkSession
    ready = prepare(vectors, column, dimension, scale, seed, block)
    centroids = first_centroids(ready, k)
    rows = ready.select("vec_id", "q", "z")
    schema = rows.select("vec_id").schema.add("cluster", "integer").add("distance", "long").add("checked", "integer")
    if not len(centroids):
        names = "cluster_inertia long, inertia long, centroid array<long>"
        return spark.createDataFrame([], schema).join(spark.createDataFrame([], f"cluster int, {names}"), "cluster").select(*schema.names, "cluster_inertia", "inertia", "centroid")
    for _ in range(rounds):
        centroids = moved(ready, centroids, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, number, distance, checked in _assigned(batches, centroids, block):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(distance), pa.array(checked, pa.int32())], schema.names)

    found = materialize(rows.mapInArrow(run, schema), "clustered")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    whole = sum(inertia.values())
    facts = [(c, s, whole, centroids[c].tolist()) for c, s in inertia.items()]
    # One row for each centroid, at most k of them.
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(known), "cluster").select(*schema.names, "cluster_inertia", "inertia", "centroid")


def digest(centroid: list[int]) -> str:
    """SHA-256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
