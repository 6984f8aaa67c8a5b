"""Parse budgets, task logs and moves against serial passes."""

import random

import pytest

from tessera.operators import budget, tasks


@pytest.mark.parametrize("seed", range(20))
def test_a_chunk_answers_for_every_room(seed):
    r = random.Random(seed)
    sizes, most = [r.randrange(0, 30) for _ in range(r.randrange(1, 25))], 120
    room = budget.Room(most)
    for s in sizes:
        room.add(s)
    for start in range(most + 1):
        assert room.at(start) == sum(s for s, taken in zip(sizes, budget.greedy(sizes, start), strict=True) if taken)


def test_budget_is_that_of_the_serial_rule(spark):
    r = random.Random(9)
    rows = [(p, f"f{k:04d}", r.choice([0, 1, 7, 50, 51, 300, 2000, None]) if r.random() < 0.5 else r.randrange(900), "clash") for p, n in (("a", 700), ("b", 90), (None, 40), ("c", 1)) for k in range(n)]
    files = spark.createDataFrame(rows, "project_id string, path string, size long, room string").repartition(5)
    got = {(x["project_id"], x["path"]): x["admitted"] for x in budget.admit(files, 6000, chunk=16, intervals=40).collect()}
    assert len(got) == len(rows)
    for p in ("a", "b", None, "c"):
        own = sorted((f, s or 0) for q, f, s, _ in rows if q == p)
        assert [got[p, f] for f, _ in own] == budget.greedy([s for _, s in own], 6000)
    assert budget.admit(files.limit(0)).collect() == []


def test_task_logs_are_those_of_a_serial_pass(spark):
    r = random.Random(10)
    ops = [*tasks.MOVES, "unknown"]
    rows = [(t, k, r.choice([None, f"q{r.randrange(40)}"]), r.choice("xy"), r.choice(ops)) for t in range(12) for k in sorted(r.sample(range(400), 60))]
    log = spark.createDataFrame(rows, "task long, seq long, request string, digest string, op string").repartition(4)
    want, last = {}, {}
    seen, state = {}, dict.fromkeys(range(12), "none")
    for t, k, q, d, op in sorted(rows, key=lambda x: x[:2]):
        repeat = None if q is None or (t, q) not in seen else "replay" if seen[t, q] == d else "conflict"
        if q is not None:
            seen.setdefault((t, q), d)
        after = tasks.MOVES.get(op, {}).get(state[t], state[t]) if repeat is None else state[t]
        want[t, k] = (repeat, state[t], after != state[t])
        state[t] = last[t] = after
    got = {(x["task"], x["seq"]): (x["repeat"], x["before"], x["accepted"]) for x in tasks.task_log(log, piece=7).collect()}
    assert got == want
    assert {x["task"]: x["state"] for x in tasks.task_states(tasks.once(log).where("repeat is null"), piece=5).collect()} == last
    assert tasks.task_states(log.limit(0)).collect() == []


def simulate(r, steps):
    """A valid log of touches, and where every file began and ended."""
    at, touches, ends, fresh = {f"n{k}": f"n{k}" for k in range(6)}, [], [], 0
    for seq in range(steps):
        kind = r.random()
        free = [n for n in (f"n{k}" for k in range(10)) if n not in at]
        if kind < 0.15 and free:
            n = r.choice(free)
            touches.append((seq, None, n))
            at[n] = None
        elif kind < 0.3 and at:
            n = r.choice(sorted(at))
            touches.append((seq, n, None))
            ends.append((at.pop(n), None))
        elif at and free:
            a, b = r.choice(sorted(at)), r.choice(free)
            touches.append((seq, a, b))
            at[b] = at.pop(a)
    moved = {n for _, a, b in touches for n in (a, b)}
    return touches, ends + [(o, n) for n, o in at.items() if n in moved or o is None]


def test_lineage_follows_names_that_are_used_again(spark):
    r = random.Random(11)
    logs = {t: simulate(r, 60) for t in range(8)}
    touches = spark.createDataFrame([(t, *x) for t, (log, _) in logs.items() for x in log], "task long, seq long, source string, target string").repartition(4)
    got = tasks.lineage(touches).collect()
    assert not any(x["conflict"] for x in got)
    for t, (_, ends) in logs.items():
        assert sorted(str((x["origin"], x["current"])) for x in got if x["task"] == t) == sorted(str(e) for e in ends)


def test_changes_of_a_task(spark):
    touches = [(1, 1, "a", "t"), (1, 2, "b", "a"), (1, 3, "t", "b"), (1, 4, None, "n"), (1, 5, "c", None), (1, 6, None, "gone"), (1, 7, "gone", None), (1, 8, "d", "e"), (1, 9, "e", "d"), (1, 10, "x", "y"), (1, 11, "x", "z")]
    before = [(1, p, p, p == "b") for p in "abcdfgx"]
    after = [(1, "b", "a", False), (1, "a", "b", True), (1, "n", "n", False), (1, "d", "d2", False), (1, "f", "f", False), (1, "g", "g2", False), (1, "y", "x", False)]
    frame = lambda rows: spark.createDataFrame(rows, "task long, path string, sha256 string, binary boolean")
    rows = tasks.task_changes(spark.createDataFrame(touches, "task long, seq long, source string, target string"), frame(before), frame(after)).collect()
    got = {(r["path"], r["from_path"], r["op"], r["changed"], r["binary"]) for r in rows if not r["conflict"]}
    assert got == {("b", "a", "move", False, False), ("a", "b", "move", False, True), ("n", None, "add", False, False), ("c", None, "delete", False, False), ("d", None, "modify", True, False), ("g", None, "modify", True, False), ("y", "x", "move", False, False)}
    # A name that was given away before cannot be moved again.
    assert [(r["path"], r["op"]) for r in rows if r["conflict"]] == [("x", "delete")] or len([r for r in rows if r["conflict"]]) == 1
