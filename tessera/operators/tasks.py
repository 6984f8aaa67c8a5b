"""Write tasks as logs: the state of a task, and what became of each file it moved, made or deleted.

A task's log is a word over a few operations, and each operation a map of states. Maps compose, in any grouping, so a
task's state needs no pass in order: pieces of the log are composed side by side, and the pieces' maps after them.
Renames are edges from one touch of a name to the next; the ends of their chains follow by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

STATES = ("none", "active", "pending", "completed", "rolled_back")
#: What each operation makes of each state it is accepted in. ``prepare`` and ``commit`` enclose an edit on disk.
MOVES = {
    "begin": {"none": "active"},
    "prepare": {"active": "pending"},
    "commit": {"pending": "active"},
    "abandon": {"pending": "active"},
    "finish": {"active": "completed"},
    "roll_back": {"active": "rolled_back", "pending": "rolled_back"},
}
#: Operations that are composed at once; a task of any length is cut into pieces of so many.
PIECE = 1000


def _map(op: Column) -> Column:
    """The operation as an array: for each state the state after it. Unknown operations change nothing."""
    out = F.array(*(F.lit(k) for k in range(len(STATES))))
    for name, moves in MOVES.items():
        after = [STATES.index(moves.get(s, s)) for s in STATES]
        out = F.when(op == name, F.array(*map(F.lit, after))).otherwise(out)
    return out


def _then(first: Column, second: Column) -> Column:
    return F.transform(first, lambda s: F.get(second, s))


def _composed(column: str) -> Column:
    """The maps of a list of structs (seq, map), composed in order of seq."""
    start = F.array(*(F.lit(k) for k in range(len(STATES))))
    return F.aggregate(F.array_sort(column), start, lambda m, e: _then(m, e["map"]))


def once(log: DataFrame) -> DataFrame:
    """``log`` (task, seq, request, digest, op) with ``repeat``: null for a request's first row, ``replay`` for a row that
    says the same again, ``conflict`` for one that uses its name for something else. Rows without request stand alone."""
    first = Window.partitionBy("task", "request").orderBy("seq")
    again = F.row_number().over(first) > 1
    same = F.first("digest").over(first).eqNullSafe(F.col("digest"))
    return log.withColumn("repeat", F.when(F.col("request").isNotNull() & again, F.when(same, "replay").otherwise("conflict")))


def _pieces(log: DataFrame, piece: int) -> DataFrame:
    """task, piece, map, from seq (unique in a task) cut at multiples of ``piece``."""
    rows = log.select("task", F.floor(F.col("seq") / piece).alias("piece"), F.struct("seq", _map(F.col("op")).alias("map")).alias("e"))
    return rows.groupBy("task", "piece").agg(F.collect_list("e").alias("es")).select("task", "piece", _composed("es").alias("map"))


def task_states(log: DataFrame, piece: int = PIECE) -> DataFrame:
    """task, state after all operations of ``log`` (task, seq, op), first rows of requests only; seq is a number unique in its task.

    Pieces are composed until a task has one, so no task collects more than ``piece`` maps at a time.
    """
    now = materialize(_pieces(log, piece), "pieces")
    while True:
        spread = now.agg(F.max(F.abs(F.col("piece"))).alias("m")).first()["m"]
        if not spread:
            break
        rows = now.select("task", F.floor(F.col("piece") / piece).alias("up"), F.struct(F.col("piece").alias("seq"), "map").alias("e"))
        now = materialize(rows.groupBy("task", "up").agg(F.collect_list("e").alias("es")).select("task", F.col("up").alias("piece"), _composed("es").alias("map")), "pieces")
    names = F.array(*map(F.lit, STATES))
    return now.select("task", F.get(names, F.get("map", F.lit(0))).alias("state"))


def task_log(log: DataFrame, piece: int = PIECE) -> DataFrame:
    """``log`` (task, seq, request, digest, op) with repeat, before (the state an operation meets) and accepted.

    Replays and conflicts meet a state but change nothing. Within a piece states run on from the state at its
    beginning, which the maps of the pieces before it give.
    """
    marked = materialize(once(log).withColumn("piece", F.floor(F.col("seq") / piece)), "journal")
    maps = materialize(_pieces(marked.withColumn("op", F.when(F.col("repeat").isNull(), F.col("op"))), piece), "pieces")
    order = Window.partitionBy("task").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # One row a piece, so the running list is short: a thousandth of the log.
    entry = maps.withColumn("earlier", F.collect_list(F.struct(F.col("piece").alias("seq"), "map")).over(order)).select("task", "piece", F.get(_composed("earlier"), F.lit(0)).alias("entry"))
    own = F.struct("seq", "repeat", _map(F.col("op")).alias("map"), "request", "digest", "op")
    held = marked.groupBy("task", "piece").agg(F.array_sort(F.collect_list(own)).alias("es")).join(entry, ["task", "piece"], "left")
    start = F.struct(F.coalesce("entry", F.lit(0)).alias("s"), F.array().cast("array<int>").alias("seen"))
    step = lambda a, e: F.struct(F.when(e["repeat"].isNull(), F.get(e["map"], a["s"])).otherwise(a["s"]).alias("s"), F.concat(a["seen"], F.array(a["s"])).alias("seen"))
    run = held.withColumn("seen", F.aggregate("es", start, step, lambda a: a["seen"]))
    rows = run.select("task", F.explode(F.arrays_zip("es", "seen")).alias("z")).select("task", "z.es.*", F.col("z.seen").alias("state"))
    moved = F.col("repeat").isNull() & (F.get("map", F.col("state")) != F.col("state"))
    names = F.array(*map(F.lit, STATES))
    return rows.select("task", "seq", "request", "digest", "op", "repeat", F.get(names, F.col("state")).alias("before"), moved.alias("accepted"))


def task_operations(tasks: DataFrame, operations: DataFrame) -> DataFrame:
    """Distinct operations with the columns of their tasks; operations of no task are left out."""
    return tasks.join(operations, "task").distinct()


def lineage(touches: DataFrame, max_rounds: int = 60) -> DataFrame:
    """origin, current of each file that ``touches`` (task, seq, source, target) move, make (no source) or delete (no target).

    Names may be used again, and a file may come back to its own. A touch that takes a name continues the last touch
    before it that gave the name, which a lag over the touches of each name finds. Each doubling of the pointers to
    the first touch halves what is left of the longest chain; pointers are numbers alone, and those that have come to
    a first touch stay where they are. As a chain's touches follow in order of seq, its last is that with the greatest.
    A source that was given away or never came back has ``conflict`` set, and starts a file of its own.
    """
    moves = touches.where("not (source <=> target)").select("task", "seq", "source", "target")
    gives = moves.where("target is not null").select("task", F.col("target").alias("name"), "seq", F.lit(1).alias("gives"), F.lit(None).cast("string").alias("target"))
    takes = moves.where("source is not null").select("task", F.col("source").alias("name"), "seq", F.lit(0).alias("gives"), "target")
    order = Window.partitionBy("task", "name").orderBy("seq", "gives")
    both = gives.unionByName(takes).withColumns({"last": F.lag("seq").over(order), "gave": F.lag("gives").over(order)})
    up, lost = F.when(F.col("gave") == 1, F.col("last")), F.coalesce(F.col("gave") == 0, F.lit(False))
    taken = both.where("gives = 0").select("task", "seq", F.col("name").alias("source"), "target", lost.alias("conflict"), up.alias("up"))
    made = moves.where("source is null").select("task", "seq", "source", "target", F.lit(False).alias("conflict"), F.lit(None).cast(moves.schema["seq"].dataType).alias("up"))
    chains = materialize(taken.unionByName(made), "lineage")
    ended = chains.where("up is null").select("task", "seq", F.col("seq").alias("first"))
    going = chains.where("up is not null").select("task", "seq", F.col("up").alias("first"))
    for _ in range(max_rounds):
        if going.isEmpty():
            break
        above = ended.withColumn("ended", F.lit(True)).unionByName(going.withColumn("ended", F.lit(False)))
        step = going.join(above.select("task", F.col("seq").alias("first"), F.col("first").alias("further"), "ended"), ["task", "first"])
        step = materialize(step.select("task", "seq", F.col("further").alias("first"), "ended"), "pointers")
        ended, going = ended.unionByName(step.where("ended").drop("ended")), step.where("not ended").drop("ended")
    else:
        raise RuntimeError("too many rounds")
    ends = ended.groupBy("task", "first").agg(F.max("seq").alias("seq"))
    root = chains.where("up is null").select("task", F.col("seq").alias("first"), F.col("source").alias("origin"), "conflict")
    last = ends.join(chains.select("task", "seq", F.col("target").alias("current")), ["task", "seq"]).drop("seq")
    return root.join(last, ["task", "first"]).select("task", "first", "origin", "current", "conflict")


def task_changes(touches: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """task, path, from_path, op, changed of what tasks did to files; ``before`` and ``after`` (task, path, sha256, binary).

    Files that were made and deleted again, or moved back unchanged, are no change. Edits in place need no touch.
    """
    known = lineage(touches)
    old = before.select("task", F.col("path").alias("origin"), F.col("sha256").alias("old"), F.col("binary").alias("old_binary"))
    new = after.select("task", F.col("path").alias("current"), F.col("sha256").alias("new"), F.col("binary").alias("new_binary"))
    # Files that no touch takes up come in by the same join and stay where they are.
    rows = known.withColumn("touched", F.lit(True)).join(old, ["task", "origin"], "full")
    rows = rows.withColumns({"current": F.when(F.col("touched"), F.col("current")).otherwise(F.col("origin")), "conflict": F.coalesce("conflict", F.lit(False))})
    rows = rows.where("origin is not null or current is not null").join(new, ["task", "current"], "left")
    changed = ~F.col("old").eqNullSafe(F.col("new"))
    op = (
        F.when(F.col("origin").isNull(), "add").when(F.col("current").isNull() | F.col("new").isNull(), "delete")
        .when(F.col("origin") != F.col("current"), "move").when(changed, "modify")
    )
    binary = F.coalesce("new_binary", "old_binary", F.lit(False))
    from_path = F.when((op == "move"), F.col("origin"))
    out = rows.select("task", F.coalesce("current", "origin").alias("path"), from_path.alias("from_path"), op.alias("op"), (changed & op.isin("move", "modify")).alias("changed"), binary.alias("binary"), "conflict")
    return out.where("op is not null")
