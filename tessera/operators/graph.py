"""Graph queries on edge tables (src, tgt): layers, shortest paths, components, architecture.

Every loop writes its state to the shared folder and reads it back, so lineage stays short and a lost executor
costs one round. Frontiers carry the seed they started from: a set of queries runs in the same joins as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize, maybe_broadcast

MAX_DEPTH = 5
#: Edges up to which what is left of a graph is finished in one task, at some hundred bytes an edge; beyond it rounds go on.
LOCAL_EDGES = 500_000
#: Neighbours in one list, and rows that a task of a walk tells apart.
LIST, TASK_ROWS = 1000, 2_000_000


def orient(edges: DataFrame, direction: str) -> DataFrame:
    """Distinct (src, tgt) pairs to walk along."""
    out = edges.select("src", "tgt")
    back = edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    chosen = {"outgoing": out, "incoming": back, "both": out.unionByName(back)}
    if direction not in chosen:
        raise ValueError("unknown direction")
    return chosen[direction].distinct()


class _Lists:
    """Neighbours of each node as lists of at most ``LIST``, for walks from many seeds.

    A step sends a list for each node it stands on, not a row for each neighbour, to where the seed's nodes are told apart.
    That is one place for each seed and ``bucket`` of nodes; few seeds have many buckets, so that all tasks have work.
    """

    def __init__(self, steps: DataFrame, seeds: int) -> None:
        self.least = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = -(-self.least // max(1, seeds))
        place = F.row_number().over(Window.partitionBy("src", "bucket").orderBy("tgt"))
        rows = steps.select("src", "tgt", self.bucket("tgt")).withColumn("chunk", F.floor(place / LIST))
        lists = rows.groupBy("src", "bucket", "chunk").agg(F.array_sort(F.collect_list("tgt")).alias("targets"))
        self.rows = materialize(lists.drop("chunk"), "lists")
        self.sizes = self.rows.select("src", F.size("targets").alias("n"))

    def bucket(self, node: str) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(self.buckets)).cast("int").alias("bucket")

    def tasks(self, nodes: DataFrame, count: int) -> int:
        """Tasks for what steps from ``nodes`` (src, ``count`` rows) meet, so that none holds many more than ``TASK_ROWS``."""
        met = maybe_broadcast(nodes.groupBy("src").agg(F.count("*").alias("times")), count).join(self.sizes, "src")
        return max(self.least, -(-(met.agg(F.sum(F.col("times") * F.col("n"))).first()[0] or 0) // TASK_ROWS))


def distances(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "outgoing") -> DataFrame:
    """seed, node, distance of every node within ``depth`` steps of each seed (column node).

    The last layer, which is mostly the largest, is not written but left to whoever reads the result.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be between 1 and {MAX_DEPTH}")
    seen = materialize(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("distance")).distinct(), "layer-0")
    lists = _Lists(orient(edges, direction), seen.count())
    frontier = seen
    for level in range(1, depth + 1):
        # Few values are sent to all lists, not all lists to them.
        count = frontier.count()
        at = maybe_broadcast(frontier.select("seed", F.col("node").alias("src")), count)
        met = at.join(lists.rows, "src").select("seed", "bucket", "targets", F.lit(level).alias("distance"))
        known = seen.select("seed", lists.bucket("node"), F.array("node").alias("targets"), "distance")
        both = met.unionByName(known).repartition(lists.tasks(at, count), "seed", "bucket").select("seed", "bucket", F.explode("targets").alias("node"), "distance")
        least = both.groupBy("seed", "bucket", "node").agg(F.min("distance").alias("distance")).select("seed", "node", "distance")
        if level == depth:
            return least
        frontier = materialize(least.where(F.col("distance") == level), f"layer-{level}")
        seen = seen.unionByName(frontier)


def chains(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "outgoing") -> DataFrame:
    """seed, node, distance, chain: one parent chain for each node reached; the least parent wins."""
    steps = materialize(orient(edges, direction), "steps")
    seen = materialize(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("distance"), F.array("node").alias("chain")).distinct(), "chain-0")
    frontier = seen
    for level in range(1, depth + 1):
        met = frontier.select("seed", F.col("node").alias("src"), "chain").join(steps, "src")
        best = met.groupBy("seed", F.col("tgt").alias("node")).agg(F.min_by("chain", "src").alias("chain"))
        fresh = best.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        fresh = fresh.select("seed", "node", F.lit(level).alias("distance"), F.concat("chain", F.array("node")).alias("chain"))
        frontier = materialize(fresh, f"chain-{level}")
        seen = seen.unionByName(frontier)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = MAX_DEPTH, most: int = 10) -> DataFrame:
    """source, target, length, path: all shortest paths of each pair (source, target), the first ``most`` in order."""
    pairs = materialize(pairs.select("source", "target").distinct(), "pairs")
    reach = materialize(distances(edges, pairs.select(F.col("source").alias("node")), depth), "path-layers")
    ends = pairs.join(reach.select(F.col("seed").alias("source"), F.col("node").alias("target"), "distance"), ["source", "target"])
    return _paths_back(edges, reach, ends, depth, most)


def shortest_paths_from(edges: DataFrame, seeds: DataFrame, depth: int = MAX_DEPTH, most: int = 10) -> DataFrame:
    """``shortest_paths`` of every seed (node) to every node within ``depth`` steps, itself included.

    Every node is a target, so each level keeps the first ``most`` paths of each (source, node) and extends them by
    one step to nodes not met before; the last level is not written but left to whoever reads the result. Paths of a node that extend one parent's are in the order of the parent's, so
    each of a node's first ``most`` extends one of a parent's first ``most``.
    """
    start = seeds.select(F.col("node").alias("source"), F.col("node").alias("target"), F.lit(0).alias("length"), F.array("node").alias("path")).distinct()
    done = frontier = materialize(start, "paths-0")
    lists = _Lists(edges.select("src", "tgt").distinct(), done.count())
    for level in range(1, depth + 1):
        count = frontier.count()
        at = frontier.select("source", F.col("target").alias("src"), "path")
        met = at.join(lists.rows, "src").select("source", "bucket", "path", "targets", F.lit(level).alias("length"))
        none = F.lit(None).cast(done.schema["path"].dataType).alias("path")
        known = done.select("source", lists.bucket("target"), none, F.array("target").alias("targets"), "length")
        both = met.unionByName(known).repartition(lists.tasks(at, count), "source", "bucket")
        grown = both.select("source", "bucket", "path", F.explode("targets").alias("target"), "length")
        own = Window.partitionBy("source", "bucket", "target")
        place, first = F.row_number().over(own.orderBy("length", "path")), F.min("length").over(own)
        fresh = grown.withColumns({"place": place, "first": first}).where((F.col("first") == level) & (F.col("place") <= most))
        fresh = fresh.select("source", "target", "length", F.concat("path", F.array("target")).alias("path"))
        frontier = fresh if level == depth else materialize(fresh, f"paths-{level}")
        done = done.unionByName(frontier)
    return done


def _paths_back(edges: DataFrame, layers: DataFrame, ends: DataFrame, depth: int, most: int) -> DataFrame:
    """Shortest paths from ``ends`` (source, target, distance) back through ``layers`` (seed, node, distance).

    First the nodes on a shortest path of each pair are marked, backwards from its target. Then paths grow forwards
    along marked nodes. Every marked node leads on to the target, and the order of paths is that of their beginnings,
    so keeping the first ``most`` beginnings of a pair loses none of its first ``most`` paths.
    """
    steps = materialize(edges.select("src", "tgt").distinct(), "path-steps")
    known = layers.select(F.col("seed").alias("source"), F.col("node").alias("src"), "distance")
    pairs = ends.select("source", "target", F.col("distance").alias("length"))
    at = ends.select("source", "target", F.col("target").alias("node"), "distance")
    marked = [materialize(at, "path-marks")]
    for _ in range(depth):
        back = marked[-1].where("distance > 0").select("source", "target", F.col("node").alias("tgt"), (F.col("distance") - 1).alias("distance"))
        now = back.join(steps, "tgt").join(known, ["source", "src", "distance"]).select("source", "target", F.col("src").alias("node"), "distance").distinct()
        marked.append(materialize(now, "path-marks"))
    on = marked[0]
    for more in marked[1:]:
        on = on.unionByName(more)
    on = on.select("source", "target", F.col("node").alias("tgt"), F.col("distance").alias("at"))
    paths = pairs.select("source", "target", "length", F.array("source").alias("path"))
    done = paths.where("length = 0")
    for level in range(1, depth + 1):
        grown = paths.where(F.col("length") >= level).withColumn("src", F.element_at("path", -1)).join(steps, "src")
        grown = grown.join(on.where(F.col("at") == level), ["source", "target", "tgt"]).withColumn("path", F.concat("path", F.array("tgt")))
        place = F.row_number().over(Window.partitionBy("source", "target").orderBy("path"))
        ranked = grown.withColumn("place", place).where(F.col("place") <= most)
        paths = materialize(ranked.select("source", "target", "length", "path"), "paths")
        done = done.unionByName(paths.where(F.col("length") == level))
    return done


def _whole(edges: DataFrame, schema: str, work: Callable[[list, list], tuple]) -> DataFrame:
    """``work`` on the ends of all ``edges`` (src, tgt) in one task; for edges that have been counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, tgt = [], []
        for batch in batches:
            src += batch.column(0).to_pylist()
            tgt += batch.column(1).to_pylist()
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in work(src, tgt)], names)

    names = [f.split(" ")[0] for f in schema.split(", ")]
    return edges.select("src", "tgt").coalesce(1).mapInArrow(run, schema)


def _components_of(src: list, tgt: list) -> tuple[list, list]:
    """(node, largest node of its strongly connected component), by depth-first search without recursion."""
    after: dict = {}
    for a, b in zip(src, tgt, strict=True):
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    order, low, group, held = {}, {}, {}, []
    for start in after:
        if start in order:
            continue
        order[start] = low[start] = len(order)
        held.append(start)
        walk = [(start, iter(after[start]))]
        while walk:
            node, ways = walk[-1]
            step = next((w for w in ways if w not in order or w not in group and order[w] < low[node]), None)
            if step is None:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == order[node]:
                    members = [held.pop()]
                    while members[-1] != node:
                        members.append(held.pop())
                    group.update(dict.fromkeys(members, max(members)))
            elif step in order:
                low[node] = order[step]
            else:
                order[step] = low[step] = len(order)
                held.append(step)
                walk.append((step, iter(after[step])))
    return list(group), list(group.values())


def _layers_of(src: list, tgt: list) -> tuple[list, pa.Array]:
    """(node, layer) of an acyclic graph: one above the highest of what a node leads to."""
    before: dict = {}
    left: dict = {}
    for a, b in set(zip(src, tgt, strict=True)):
        before.setdefault(b, []).append(a)
        left[a] = left.get(a, 0) + 1
        left.setdefault(b, 0)
    layer = dict.fromkeys(left, 0)
    free = [n for n, k in left.items() if not k]
    for node in free:
        for a in before.get(node, ()):
            layer[a] = max(layer[a], layer[node] + 1)
            left[a] -= 1
            if not left[a]:
                free.append(a)
    return list(layer), pa.array(list(layer.values()), pa.int32())


def components(edges: DataFrame, max_rounds: int = 200, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, scc): strongly connected components, named by their largest node.

    Nodes without a way in or out are components of their own and are trimmed away round by round. In what is
    left the largest name that reaches a node colours it; a node coloured by itself is a root, and those of its
    colour that reach it back form its component. As soon as no more than ``local`` edges are left, one task ends it.
    """
    rest = materialize(edges.select("src", "tgt").where("src <> tgt").distinct(), "scc-edges")
    nodes = materialize(edges.select(F.explode(F.array("src", "tgt")).alias("node")).distinct(), "scc-nodes")
    found = None
    for _ in range(max_rounds):
        size = rest.count()
        while size > local:
            kept = rest.join(rest.select(F.col("tgt").alias("src")).distinct(), "src", "left_semi")
            kept = kept.join(rest.select(F.col("src").alias("tgt")).distinct(), "tgt", "left_semi")
            kept = materialize(kept.select("src", "tgt"), "scc-trimmed")
            now = kept.count()
            rest = kept
            if now == size:
                break
            size = now
        if size <= local:
            if size:
                members = materialize(_whole(rest, f"node {rest.schema['src'].dataType.simpleString()}, scc {rest.schema['src'].dataType.simpleString()}", _components_of), "scc-found")
                found = members if found is None else found.unionByName(members)
            break
        colours = materialize(rest.select(F.explode(F.array("src", "tgt")).alias("node")).distinct().select("node", F.col("node").alias("colour")), "scc-colours")
        while True:
            pushed = rest.join(colours.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("tgt").alias("node")).agg(F.max("colour").alias("other"))
            step = colours.join(pushed, "node", "left").select("node", F.greatest("colour", "other").alias("colour"), (F.col("other") > F.col("colour")).alias("moved"))
            step = materialize(step, "scc-colours")
            colours = step.select("node", "colour")
            if step.where("moved").isEmpty():
                break
        a = colours.select(F.col("node").alias("src"), F.col("colour").alias("ca"))
        b = colours.select(F.col("node").alias("tgt"), F.col("colour").alias("cb"))
        inner = materialize(rest.join(a, "src").join(b, "tgt").where("ca = cb").select("src", "tgt", F.col("ca").alias("colour")), "scc-inner")
        members = frontier = materialize(colours.where("node = colour"), "scc-members")
        while not frontier.isEmpty():
            back = inner.join(frontier.select(F.col("node").alias("tgt"), "colour"), ["tgt", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            frontier = materialize(back.join(members, ["node", "colour"], "left_anti"), "scc-frontier")
            members = members.unionByName(frontier)
        members = materialize(members.select("node", F.col("colour").alias("scc")), "scc-found")
        found = members if found is None else found.unionByName(members)
        taken = members.select("node")
        rest = rest.join(taken.withColumnRenamed("node", "src"), "src", "left_anti").join(taken.withColumnRenamed("node", "tgt"), "tgt", "left_anti")
        rest = materialize(rest.select("src", "tgt"), "scc-edges")
    else:
        raise RuntimeError("too many rounds")
    if found is None:
        return nodes.select("node", F.col("node").alias("scc"))
    alone = nodes.join(found, "node", "left_anti").select("node", F.col("node").alias("scc"))
    return alone.unionByName(found)


def layers(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """node, scc, layer, cyclic: layer 0 depends on nothing outside its component, else one above the highest.

    Components are peeled: a component gets its layer in the round in which all it depends on have theirs. A
    component is cyclic if it has several nodes or an edge to itself. No more than ``local`` edges left are done in one task.
    """
    pairs = materialize(edges.select("src", "tgt").distinct(), "layer-edges")
    sccs = materialize(components(pairs, local=local), "layer-sccs")
    a = sccs.select(F.col("node").alias("src"), F.col("scc").alias("a"))
    b = sccs.select(F.col("node").alias("tgt"), F.col("scc").alias("b"))
    open_edges = materialize(pairs.join(a, "src").join(b, "tgt").where("a <> b").select("a", "b").distinct(), "layer-dag")
    waiting = materialize(sccs.select("scc").distinct(), "layer-waiting")
    done, level = None, 0
    while True:
        if open_edges.count() <= local:
            # What still waits stands above ``level``: its ways down to layers that are known have been taken off.
            kind = sccs.schema["scc"].dataType.simpleString()
            above = _whole(open_edges.select(F.col("a").alias("src"), F.col("b").alias("tgt")), f"scc {kind}, up int", _layers_of)
            rest = waiting.join(above, "scc", "left").select("scc", (F.coalesce("up", F.lit(0)) + level).alias("layer"))
            done = materialize(rest if done is None else done.unionByName(rest), "layer")
            break
        free = materialize(waiting.join(open_edges.select(F.col("a").alias("scc")).distinct(), "scc", "left_anti").withColumn("layer", F.lit(level)), "layer")
        if free.isEmpty():
            break
        level += 1
        done = free if done is None else done.unionByName(free)
        waiting = materialize(waiting.join(free, "scc", "left_anti"), "layer-waiting")
        open_edges = materialize(open_edges.join(free.select(F.col("scc").alias("b")), "b", "left_anti").select("a", "b"), "layer-dag")
    if done is None:
        return sccs.withColumn("layer", F.lit(0)).withColumn("cyclic", F.lit(False))
    loops = pairs.where("src = tgt").select(F.col("src").alias("node")).withColumn("loop", F.lit(True))
    sizes = sccs.groupBy("scc").agg(F.count("*").alias("n"))
    own = sccs.join(sizes, "scc").join(loops, "node", "left")
    cyclic = own.groupBy("scc").agg(F.bool_or((F.col("n") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic"))
    return sccs.join(done, "scc").join(cyclic, "scc").select("node", "scc", "layer", "cyclic")


def weak_order(node_layers: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` nodes by layer and name, as an architecture report shows them."""
    return node_layers.orderBy("layer", "node").limit(limit)
