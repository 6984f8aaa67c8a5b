"""SimHash near-duplicates found with sharded BK-trees.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles. Its bits are cut into
``RADIUS + spare`` blocks. Two fingerprints that differ in at most ``RADIUS`` bits agree exactly on at least
``spare`` of them, so each choice of ``spare`` blocks is a key, a shard holds all fingerprints with one value of a
key, and no link leaves every shard. ``spare`` grows with the logarithm of the number of fingerprints, so chance
meetings in a shard stay few and the work grows little faster than the corpus. Each shard is a BK-tree: children
hang at their integer Hamming distance from the parent, and a search follows only the edges whose distance lies
within the radius of the query's own distance. A shard of more than ``TREE`` fingerprints is cut into trees of
that size, and every pair of trees of the shard is one task's work, so no task holds a whole hot shard.

A shard reports a spanning forest of its links, not the pairs: one row for each fingerprint that has a smaller
neighbour's root. Components then follow by alternating star contractions on those rows.

``similar_groups`` is the same search for a Jaccard similarity in place of a number of bits: wider fingerprints,
shards by random choices of bits, BK-trees, and an exact check of the links they find.

Equal fingerprints collapse before any shuffle of pairs. Texts without words have fingerprint zero, null text
counts as empty, and rows without doc_id take part but never name a component unless it has no other name. An
empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import numbered, row_id
from tessera.session import materialize, maybe_broadcast

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints in one tree.
TREE = 2048
#: Fingerprints that may meet in a shard by chance, on average.
MEAN = 16
#: Blocks in a key at least. Keys of two blocks serve 33 million fingerprints, so the rows under keys grow with the input alone up to there.
SPARE = 2
_SLICE = 1 << 15
#: Shingles of one tree of texts that are compared exactly.
TREE_SHINGLES = 1 << 21
#: Groups by similarity: shingles of so many words, least Jaccard similarity, share of pairs just there that may be missed.
WIDE_SHINGLE, SIMILARITY, MISS = 5, 0.8, 0.05
#: Words of 64 bits in a wide fingerprint, and an odd multiplier for each.
WORDS = 4
_MIX = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64)) for k in range(WORDS)]


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles (A-Z lower-cased, words joined by one space), repeats included, in slices."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    flat = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _SLICE):
        yield np.array([digest(flat[a:b], SEED) for a, b in zip(starts[at : at + _SLICE], stops[at : at + _SLICE], strict=True)], np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the values have each of the 64 bits."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle):
        counts += bit_counts(h)
        n += len(h)
    return sum(1 << b for b in np.flatnonzero(counts * 2 > n).tolist())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, rid: str | None = None) -> DataFrame:
    """rid, doc_id, fp (the 64 bits as a signed long) for every row."""
    rows = docs.select(row_id(rid), "doc_id", "text")
    schema = rows.select("rid", "doc_id").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["rid", "doc_id", "fp"])

    return rows.mapInArrow(run, schema)


class BKTree:
    """A BK-tree over integers under Hamming distance."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.value.append(value)
        self.children.append({})
        new = len(self.value) - 1
        if not new:
            return
        at = 0
        while True:
            d = (self.value[at] ^ value).bit_count()
            step = self.children[at].get(d)
            if step is None:
                self.children[at][d] = new
                return
            at = step

    def within(self, value: int, radius: int) -> list[int]:
        """Indexes, in order of insertion, of the values at distance ``radius`` or less."""
        found, todo = [], [0] if self.value else []
        values, children = self.value, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if below:
                lo, hi = d - radius, d + radius
                if len(below) > hi - lo:
                    todo += [below[k] for k in range(max(lo, 0), hi + 1) if k in below]
                else:
                    todo += [i for k, i in below.items() if lo <= k <= hi]
        return found


def forest(left: list[int], right: list[int] | None, radius: int, nearest: bool = False) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``left``, or between ``left`` and ``right``; ``nearest`` prefers short links."""
    values = left + (right or [])
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree, out = BKTree(), []
    if right is not None:
        for v in left:
            tree.add(v)
    for i in range(len(left) if right is not None else 0, len(values)):
        found = tree.within(values[i], radius)
        if nearest:
            found.sort(key=lambda j: (values[i] ^ values[j]).bit_count())
        for j in found:
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((values[i], values[j]))
        if right is None:
            tree.add(values[i])
    return out


def between(left: list[tuple[int, int]], right: list[tuple[int, int]] | None, radius: int) -> list[tuple[int, int]]:
    """``forest`` of (value, root) whose values are already together where their roots are the same, nearest links
    first. Values of the most frequent root are only found, by others, and do not search."""
    parent = {root: root for _, root in left + (right or [])}
    if len(parent) < 2:
        return []
    common, out = Counter(root for _, root in left + (right or [])).most_common(1)[0][0], []

    def top(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    for held, asking in ((left, left),) if right is None else ((left, right), (right, left)):
        tree = BKTree()
        for v, _ in held:
            tree.add(v)
        for v, root in asking:
            if root != common:
                for j in sorted(tree.within(v, radius), key=lambda j: ((v ^ held[j][0]).bit_count(), held[j][0])):
                    a, b = top(root), top(held[j][1])
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        out.append((v, held[j][0]))
    return out


def alike(left: list[tuple[int, int, np.ndarray]], right: list[tuple[int, int, np.ndarray]] | None, similarity: float) -> list[tuple[int, int]]:
    """Links between (node, root, shingle set) whose sets have this Jaccard similarity: a spanning forest of all of them
    within ``left``, or between ``left`` and ``right``, over what is already together where roots are the same.

    A list of its texts for each shingle counts what a text shares with all others at once. Texts of the most frequent
    root are only found, by others, and do not search.
    """
    parent = {root: root for _, root, _ in left + (right or [])}
    groups, out = len(parent), []
    common = Counter(root for _, root, _ in left + (right or [])).most_common(1)[0][0]

    def top(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    for held, asking in ((left, left),) if right is None else ((left, right), (right, left)):
        if groups < 2 or not held:
            break
        sizes = np.array([len(x) for _, _, x in held])
        flat = np.concatenate([x for _, _, x in held])
        order = np.argsort(flat, kind="stable")
        flat, texts = flat[order], np.repeat(np.arange(len(held)), sizes)[order]
        for node, root, own in asking:
            if root == common:
                continue
            at, stop = np.searchsorted(flat, own), np.searchsorted(flat, own, "right")
            met = [texts[a:b] for a, b in zip(at.tolist(), stop.tolist(), strict=True) if a < b]
            shared = np.bincount(np.concatenate(met), minlength=len(held)) if met else np.zeros(len(held), np.int64)
            for j in np.flatnonzero(shared / np.maximum(len(own) + sizes - shared, 1) >= similarity).tolist():
                a, b = top(root), top(held[j][1])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((node, held[j][0]))
                    groups -= 1
            if groups < 2:
                break
    return out


def spare_blocks(n: int, radius: int, mean: int = MEAN) -> int:
    """The fewest blocks in a key with which ``n`` random fingerprints meet ``mean`` others or less in a shard."""
    return next(s for s in range(1, 64) if s == 60 - radius or mean * 2.0 ** (64 * s / (radius + s)) >= n)


def key_masks(radius: int, spare: int) -> list[int]:
    """One mask of bits (a signed long) for each choice of ``spare`` of ``radius + spare`` blocks."""
    edges = np.linspace(0, 64, radius + spare + 1).round().astype(int).tolist()
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return [int(np.array(sum(chosen), np.uint64).view(np.int64)) for chosen in combinations(blocks, spare)]


def links(fps: DataFrame, radius: int = RADIUS, tree: int = TREE, spare: int = 1) -> DataFrame:
    """(a, b): links between distinct fingerprints, a spanning forest for each tree or pair of trees."""
    cells = F.array(*(F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(mask)).alias("value")) for k, mask in enumerate(key_masks(radius, spare))))
    rows = fps.select("fp", F.explode(cells).alias("c")).select("fp", "c.band", "c.value")
    sizes = rows.groupBy("band", "value").count().where("count > 1").withColumn("trees", F.ceil(F.col("count") / tree).cast("int"))
    placed = rows.join(sizes.select("band", "value", "trees"), ["band", "value"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    pairs = placed.select("fp", "band", "value", "own", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("other"))
    cell = [F.col("band"), F.col("value"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    dealt = pairs.select(*cell, (F.col("own") > F.col("other")).alias("right"), "fp")
    dealt = dealt.repartition("band", "value", "i", "j").sortWithinPartitions("band", "value", "i", "j", "right", "fp")
    mask = (1 << 64) - 1

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def close(key: tuple, left: list[int], right: list[int]) -> list[tuple[int, int]]:
            return forest(left, None if key[2] == key[3] else right, radius)

        key, sides = None, ([], [])
        for df in batches:
            found = []
            columns = zip(df["band"].tolist(), df["value"].tolist(), df["i"].tolist(), df["j"].tolist(), df["right"].tolist(), df["fp"].tolist(), strict=True)
            for band, value, i, j, right, fp in columns:
                if (band, value, i, j) != key:
                    if key:
                        found += close(key, *sides)
                    key, sides = (band, value, i, j), ([], [])
                sides[right].append(fp & mask)
            yield signed(found)
        if key:
            yield signed(close(key, *sides))

    def signed(found: list[tuple[int, int]]) -> pd.DataFrame:
        both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    return dealt.mapInPandas(search, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Alternating large-star and small-star contractions; every round is written before the next one reads it.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("r")).where("v <> r").distinct(), "stars-0")
    for k in range(1, max_rounds + 1):
        both = now.unionByName(now.select(F.col("r").alias("v"), F.col("v").alias("r")))
        low = both.groupBy("v").agg(F.least(F.min("r"), F.col("v")).alias("m"))
        large = both.join(low, "v").where("r > v").select(F.col("r").alias("v"), F.col("m").alias("r")).distinct()
        large = materialize(large, f"large-{k}")
        low = large.groupBy("v").agg(F.min("r").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("r")), F.struct(F.col("r").alias("v"), F.col("m").alias("r")))).alias("e"))
        before, now = now, materialize(small.select("e.v", "e.r").where("v <> r").distinct(), f"stars-{k}")
        if now.count() == before.count() and now.join(before, ["v", "r"], "left_anti").isEmpty():
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("r").alias("root")).unionByName(now.select(F.col("r").alias("node"), F.col("r").alias("root")).distinct())


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tree: int = TREE, rid: str | None = None) -> DataFrame:
    """rid, doc_id, fp, component_id, first_rid for every row of ``docs``.

    component_id is the smallest doc_id of the component, first_rid the row that carries it.
    """
    rows = materialize(fingerprints(docs, shingle, rid), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min(_order()).alias("first")), "distinct-fingerprints")
    spare = max(SPARE, spare_blocks(distinct.count(), radius))
    found = components(links(distinct.select("fp"), radius, tree, spare))
    return named(rows, distinct.withColumn("node", F.col("fp")), found)


def _order() -> F.Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rid").alias("rid"))


def named(rows: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (rid, doc_id, fp) with the names of their components; ``distinct`` has fp, node and first, ``found`` node and root."""
    rooted = materialize(distinct.join(found, "node", "left").select("fp", "first", F.coalesce("root", "node").alias("root")), "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    names = rooted.select("fp", "root").join(firsts, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.rid").alias("first_rid"))
    return rows.join(names, "fp").select("rid", "doc_id", "fp", "component_id", "first_rid")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """One row of each group of ``similar_groups``, the one with the smallest doc_id, with all columns."""
    own = docs.columns
    rows = numbered(docs, F.struct(*own).alias("row"))
    found = similar_groups(rows.select("rid", "row.doc_id", "row.text"), similarity, shingle, rid="rid")
    gone = found.where("rid <> first_rid").select("rid")
    return rows.join(gone, "rid", "left_anti").select(*(F.col("row")[c].alias(c) for c in own))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The ``WORDS`` 64-bit words of a SimHash over distinct shingle hashes, each word from hashes mixed anew."""
    counts = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(shingles), _SLICE):
        for k, odd in enumerate(_MIX):
            h = shingles[at : at + _SLICE] * odd
            h ^= h >> np.uint64(32)
            h *= _MIX[0]
            h ^= h >> np.uint64(29)
            counts[k] += bit_counts(h)
    return np.packbits(counts * 2 > len(shingles), axis=1, bitorder="little").view(np.uint64).reshape(WORDS)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def wide_fingerprints(docs: DataFrame, shingle: int, rid: str | None = None) -> DataFrame:
    """rid, doc_id, fp (the words of ``wide_fingerprint`` as bytes) for every row."""
    rows = docs.select(row_id(rid), "doc_id", "text")
    schema = rows.select("rid", "doc_id").schema.add("fp", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [wide_fingerprint(shingle_set(t, shingle)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary())], ["rid", "doc_id", "fp"])

    return rows.mapInArrow(run, schema)


def differing(similarity: float) -> float:
    """The share of bits in which the SimHashes of two sets of equal size and this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def drawn_keys(n: int, similarity: float, miss: float = MISS, mean: int = MEAN) -> np.ndarray:
    """Masks (keys x ``WORDS``) of random bits, enough that a pair of this similarity shares a key but for a share ``miss``.

    A key has so many bits that ``n`` random fingerprints meet about ``mean`` others. The number of keys is the
    least for which the share missed, over the spread of the distance, is small enough; it grows with a small power
    of ``n``, since similar pairs agree on far more bits than others.
    """
    size, p = 64 * WORDS, differing(similarity)
    bits = max(8, math.ceil(math.log2(max(1, n / mean))))
    distance = np.arange(size + 1)
    logs = np.array([math.lgamma(size + 1) - math.lgamma(d + 1) - math.lgamma(size - d + 1) for d in distance])
    chance = np.exp(logs + distance * math.log(p) + (size - distance) * math.log1p(-p)) if p else (distance == 0) * 1.0
    apart = 1 - np.prod([np.maximum(size - distance - b, 0) / (size - b) for b in range(bits)], axis=0)
    keys = 1
    while (chance * apart**keys).sum() > miss:
        keys += 1
    rng = np.random.default_rng(7)
    chosen = np.zeros((keys, size), np.uint8)
    for k in range(keys):
        chosen[k, rng.choice(size, bits, replace=False)] = 1
    return np.packbits(chosen, axis=1, bitorder="little").view(np.int64)


def wide_radius(similarity: float) -> int:
    """The distance that all but a hundredth of the pairs of this similarity do not exceed."""
    size, p = 64 * WORDS, differing(similarity)
    return math.ceil(size * p + 2.33 * math.sqrt(size * p * (1 - p)))


def in_cells(nodes: DataFrame, masks: np.ndarray, weight: F.Column) -> DataFrame:
    """``nodes`` (node, fp, more) dealt to cells (cell, i, j, right): bits under one mask name a shard.

    A shard of more than a ``weight`` of one is cut into trees and each pair of them is a cell, as in ``links``; only
    those shards, found by summing, are joined, so rows travel once. Trees and their order follow from the
    fingerprints alone, so reruns agree however the rows are numbered.
    """
    own = nodes.columns
    words = [F.conv(F.hex(F.substring("fp", 8 * k + 1, 8)), 16, -10).cast("long") for k in range(WORDS)]
    keys = F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(int(m)).alias(f"m{j}") for j, m in enumerate(row))) for k, row in enumerate(masks)))
    under = [F.col(f"w{j}").bitwiseAND(F.col(f"c.m{j}")) for j in range(WORDS)]
    keyed = lambda rows: rows.withColumns({f"w{k}": w for k, w in enumerate(words)}).withColumn("c", F.explode(keys)).withColumn("cell", F.xxhash64("c.k", *under))
    sums = keyed(nodes.select("fp", weight.alias("weight"))).groupBy("cell").agg(F.sum("weight").alias("weight"))
    hot = materialize(sums.where("weight > 1").select("cell", F.ceil("weight").cast("int").alias("trees")), "hot-cells")
    placed = keyed(nodes).select(*own, "cell").join(maybe_broadcast(hot, hot.count()), "cell", "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    pairs = placed.select(*own, "cell", "own", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("other"))
    at = [F.col("cell"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    dealt = pairs.select(*at, (F.col("own") > F.col("other")).alias("right"), *own)
    return dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "right", "fp")


def searched(dealt: DataFrame, close: Callable[[list, list | None], list[tuple[int, int]]]) -> DataFrame:
    """(a, b), distinct: what ``close`` finds among the rows of each cell, or between its two sides; node names the ends."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found_in(key: tuple, left: list, right: list) -> list[tuple[int, int]]:
            return close(left, None if key[1] == key[2] else right) if len(left) + len(right) > 1 else []

        def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both.max(1, initial=-1)), pa.array(both.min(1, initial=1 << 62))], ["a", "b"])

        key, sides = None, ([], [])
        for rows in batches:
            found = []
            for cell, i, j, right, *row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if (cell, i, j) != key:
                    if key:
                        found += found_in(key, *sides)
                    key, sides = (cell, i, j), ([], [])
                sides[right].append(row)
            yield batch(found)
        if key:
            yield batch(found_in(key, *sides))

    return dealt.mapInArrow(search, "a long, b long").distinct()


def candidates(nodes: DataFrame, masks: np.ndarray, radius: int, tree: int = TREE) -> DataFrame:
    """(a, b), distinct: near pairs of ``nodes`` (node, fp, root), a spanning forest of short links between different
    roots for each tree or pair of trees of at most ``tree`` rows on average."""

    def close(left: list, right: list | None) -> list[tuple[int, int]]:
        sides = [None if side is None else [(int.from_bytes(fp, "little"), root) for _, fp, root in side] for side in (left, right)]
        both = left + (right or [])
        name = {int.from_bytes(fp, "little"): node for node, fp, _ in both}
        if len({root for _, _, root in both}) < len(both):
            found = between(*sides, radius)
        else:
            found = forest(*(None if side is None else [fp for fp, _ in side] for side in sides), radius, nearest=True)
        return [(name[a], name[b]) for a, b in found]

    return searched(in_cells(nodes.select("node", "fp", "root"), masks, F.lit(1.0 / tree)), close)


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """rid, n, set (the hashes of the n distinct shingles as longs in order, as bytes) for every row of ``rows`` (rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.sort(shingle_set(t, shingle).view(np.int64)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["rid", "n", "set"])

    return rows.select("rid", "text").mapInArrow(run, "rid long, n long, set binary")


def verified(pairs: DataFrame, rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The ``pairs`` (a, b) whose texts in ``rows`` (rid, text) have this Jaccard similarity of distinct shingles, exactly."""
    met = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle).view(np.int64) for t in batch.column(1).to_pylist()]
            edges = np.cumsum([0, *map(len, sets)])
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), flat).cast(pa.list_(pa.int64()))], ["rid", "set"])

    sets = materialize(rows.select("rid", "text").join(met, "rid", "left_semi").mapInArrow(run, "rid long, set array<long>"), "shingle-sets")
    side = lambda c: sets.select(F.col("rid").alias(c), F.col("set").alias(f"set_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(shared / (F.size("set_a") + F.size("set_b") - shared) >= similarity).select("a", "b")


def exact_links(nodes: DataFrame, rows: DataFrame, masks: np.ndarray, similarity: float, shingle: int, tree: int = TREE) -> DataFrame:
    """(a, b), distinct: the links by exact similarity of all ``nodes`` (node, fp, root) that meet under a mask, but for
    those that others make needless: a spanning forest for each tree or pair of trees. ``rows`` (rid, text) has their texts.

    The shingle sets travel with the nodes, once for each mask, so this is for nodes that a cheaper search left open.
    A tree also ends at ``TREE_SHINGLES`` shingles on average.
    """
    sets = shingle_sets(rows.join(nodes.select(F.col("node").alias("rid")), "rid", "left_semi"), shingle)
    own = materialize(nodes.join(sets.withColumnRenamed("rid", "node"), "node").select("node", "fp", "root", "n", "set"), "open-sets")
    weight = F.greatest(F.lit(1.0 / tree), F.col("n") / F.lit(float(TREE_SHINGLES)))

    def close(left: list, right: list | None) -> list[tuple[int, int]]:
        sides = [None if side is None else [(node, root, np.frombuffer(found, np.int64)) for node, _, root, _, found in side] for side in (left, right)]
        return alike(*sides, similarity)

    return searched(in_cells(own, masks, weight), close)


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, rid: str | None = None, miss: float = MISS, tree: int = TREE) -> DataFrame:
    """rid, doc_id, fp, component_id, first_rid for every row of ``docs``: groups of texts at this Jaccard similarity or more.

    Texts are sets of word shingles. A SimHash of 256 bits puts them into shards by random choices of its bits, the
    shards' BK-trees give candidates, and candidates are kept if their exact similarity suffices. The first rounds
    check a spanning forest of each tree's links, the second of them between the groups that a few keys have left.
    Where a link fails and its ends stay in different groups, a tree may hold another link between them. So the members
    of such groups are dealt to their shards again, with their shingle sets, and linked by exact similarity to all they
    meet there. A group without a failed link to another is whole as far as any tree can tell: the forest of a tree
    leads from a text to each of its neighbours, and the first step out of its group would be a failed link. A pair
    that lies exactly at ``similarity`` shares no key with a chance of about ``miss``, a closer one with less.
    Null text counts as empty, texts without words are alike, an empty table gives an empty result.
    """
    own = materialize(docs.select(row_id(rid), "doc_id", "text"), "numbered-texts") if rid is None else docs
    rows = materialize(wide_fingerprints(own, shingle, "rid"), "wide-fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min(_order()).alias("first")).withColumn("node", F.col("first.rid")), "distinct-fingerprints")
    masks, radius = drawn_keys(distinct.count(), similarity, miss), wide_radius(similarity)
    placed = distinct.select("node", "fp", F.col("node").alias("root"))

    def merged(links: DataFrame, placed: DataFrame) -> DataFrame:
        """``placed`` with the roots that ``links`` leave; only roots are contracted."""
        root = lambda c: placed.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        ends = links.join(root("a"), "a").join(root("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        now = components(ends).select(F.col("root").alias("to"), F.col("node").alias("root"))
        return materialize(placed.join(now, "root", "left").select("node", "fp", F.coalesce("to", "root").alias("root")), "placed")

    # A few keys unite most of a large group, so that the many others need not report it again.
    head = max(1, len(masks) // 8)
    pairs = links_ = None
    for some in (masks[:head], masks[head:]):
        if not len(some):
            continue
        new = candidates(placed, some, radius, tree)
        new = materialize(new if pairs is None else new.join(pairs, ["a", "b"], "left_anti"), "candidates")
        found = materialize(verified(new, own, similarity, shingle), "links")
        pairs, links_ = (new, found) if pairs is None else (pairs.unionByName(new), links_.unionByName(found))
        placed = merged(found, placed)
    rooted = lambda side: placed.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    ends = pairs.join(links_, ["a", "b"], "left_anti").join(rooted("a"), "a").join(rooted("b"), "b").where("root_a <> root_b")
    roots = ends.select(F.explode(F.array("root_a", "root_b")).alias("root")).distinct()
    unsure = materialize(placed.join(roots, "root", "left_semi").select("node", "fp", "root"), "unsure")
    if not unsure.isEmpty():
        # Links lie within the groups searched, so only their roots change.
        unsure = merged(materialize(exact_links(unsure, own, masks, similarity, shingle, tree), "links"), unsure)
    moved = unsure.select("node", F.col("root").alias("to"))
    return named(rows, distinct, placed.join(moved, "node", "left").select("node", F.coalesce("to", "root").alias("root")))
