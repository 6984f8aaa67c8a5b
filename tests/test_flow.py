"""Value flow with matched calls and returns against walks that carry their call stack."""

import collections
import random

from tessera.operators import flow

COLUMNS = "source string, target string, kind string, resolution string, path string, line int, column int, basis string"


def program(seed, functions=4):
    """Random functions with calls between them, recursive ones included."""
    r, edges = random.Random(seed), []
    node = lambda f, what, line=0, column=0: f"m{seed}.py|f{f}|{what}|{line}|{column}"
    add = lambda s, t, kind, line: edges.append((s, t, kind, "static", f"m{seed}.py", line, 1, "x"))
    line = 0
    for f in range(functions):
        sources, sinks = [node(f, "param x"), node(f, "param y")], [node(f, "return")]
        for _ in range(r.randint(1, 3)):
            line += 1
            slot, result = node(f, "arg 0", line, 1), node(f, "call", line, 1)
            add(slot, result, "TRANSFORM", line)
            if r.random() < 0.9:
                g = r.randrange(functions)
                add(slot, node(g, r.choice(["param x", "param y"])), "ARG_TO_PARAM", line)
                add(node(g, "return"), result, "RETURN_TO_CALLSITE", line)
            sources.append(result)
            sinks.append(slot)
        for k in range(2):
            v = node(f, "v", 100 * f + k + 1, 2)
            sources.append(v)
            sinks.append(v)
        for _ in range(len(sources) + 2):
            add(r.choice(sources), r.choice(sinks), "ASSIGN", line)
    return edges


def walks(edges, start, deepest=9):
    """Nodes reached from ``start``, each state with the call sites that are open; a return without one leaves to any caller."""
    bound = {e[0] for e in edges if e[2] == "ARG_TO_PARAM"}
    results = {e[1] for e in edges if e[2] == "RETURN_TO_CALLSITE"}
    after = collections.defaultdict(list)
    for s, t, kind, *_, line, column, _ in edges:
        if not (kind == "TRANSFORM" and s in bound and t in results):
            after[s].append((t, kind, line))
    todo, seen = [(start, ())], {(start, ())}
    while todo:
        at, stack = todo.pop()
        for t, kind, line in after[at]:
            if kind == "ARG_TO_PARAM":
                new = (*stack, line)
            elif kind == "RETURN_TO_CALLSITE":
                if stack and stack[-1] != line:
                    continue
                new = stack[:-1]
            else:
                new = stack
            if len(new) <= deepest and (t, new) not in seen:
                seen.add((t, new))
                todo.append((t, new))
    return {n for n, _ in seen}


def test_matched_flow_is_that_of_walks_with_a_stack(spark):
    edges = [e for seed in range(8) for e in program(seed)]
    nodes = sorted({n for e in edges for n in e[:2]})
    reach = {n: walks(edges, n) for n in nodes}
    table, values = spark.createDataFrame(edges, COLUMNS), spark.createDataFrame([(n,) for n in nodes], "node string")
    known, whole = flow.summaries(table)
    ahead, back = collections.defaultdict(set), collections.defaultdict(set)
    for r in flow.matched_impact(table, values, known=known).collect():
        assert r["limit"] is None
        ahead[r["seed"]].add(r["node"])
    for r in flow.matched_origin(table, values, known=known).collect():
        back[r["seed"]].add(r["node"])
    assert whole and ahead == reach
    assert back == {n: {m for m in nodes if n in reach[m]} for n in nodes}


def test_a_value_leaves_by_the_call_it_entered_by_and_limits_are_told(spark):
    code = "def same(v):\n    return v\n\ndef one(a):\n    p = same(a)\n    return p\n\ndef two(b):\n    q = same(b)\n    return q\n"
    from tessera.plans.api import Project

    project = Project(spark.createDataFrame([("m.py", code, "0", len(code), "python")], "path string, content string, sha256 string, size long, language string"))
    edges = project.value_flow()
    seed = spark.createDataFrame([(flow.parameter("m.py", "one", "a"),)], "node string")
    loose = {r["node"] for r in flow.impact(edges, seed, 5).collect()} | {r["node"] for r in flow.impact(edges, spark.createDataFrame([(flow.returned("m.py", "same"),)], "node string"), 5).collect()}
    tight = {r["node"] for r in flow.matched_impact(edges, seed).collect()}
    assert flow.returned("m.py", "two") in loose and flow.returned("m.py", "two") not in tight and flow.returned("m.py", "one") in tight
    assert {r["limit"] for r in flow.matched_impact(edges, seed, steps=1).collect()} == {"steps"}
    assert {r["limit"] for r in flow.matched_impact(edges, seed, nodes=3).collect()} == {"nodes"}


def test_edges_meet_once_and_walks_write_no_ways(spark, monkeypatch):
    edges = spark.createDataFrame(program(3) + program(4), COLUMNS)
    written = []
    monkeypatch.setattr(flow, "materialize", lambda df, name, real=flow.materialize: written.append(name) or real(df, name))
    values = edges.select("source").distinct().limit(5).withColumnRenamed("source", "node")
    flow.matched_impact(edges, values).collect()
    assert written.count("flow-local") == 1 and "flow-ways" not in written
    inside = {e[:2] for e in program(3) + program(4) if e[2] not in ("ARG_TO_PARAM", "RETURN_TO_CALLSITE")}
    bound = {e[0] for e in program(3) + program(4) if e[2] == "ARG_TO_PARAM"}
    results = {e[1] for e in program(3) + program(4) if e[2] == "RETURN_TO_CALLSITE"}
    got = sorted(map(tuple, flow._local(edges).collect()))
    assert got == sorted(e for e in inside if not (e[0] in bound and e[1] in results)) and len(got) < len(inside)


def spread(edges, start):
    """Distance of all nodes that a walk from ``start`` reaches which first leaves functions and then enters them, summaries as steps."""
    after = collections.defaultdict(list)
    for s, t, way in edges:
        after[s].append((t, way))
    far, layer, level = {}, {(start, False)}, 0
    met = set(layer)
    while layer:
        for node, _ in layer:
            far.setdefault(node, level)
        layer = {(t, entered or way == flow.DOWN) for n, entered in layer for t, way in after[n] if not (entered and way == flow.UP)} - met
        met |= layer
        level += 1
    return far


def test_walks_without_limits_go_to_their_end_by_the_shortest_way(spark):
    # Two chains of forty functions each, the second of which ends in a circle and is also entered halfway, besides random programs.
    node = lambda f, what, line=0: f"c.py|{f}|{what}|{line}|1"
    edges = [e for seed in range(20, 23) for e in program(seed, 5)]
    for k in range(80):
        to = {39: None, 79: 60}.get(k, k + 1)
        slot = node(f"g{k}", "arg 0", k + 1)
        edges.append((node(f"g{k}", "param x"), slot, "ASSIGN", "static", "c.py", k + 1, 1, "x"))
        if to is not None:
            edges.append((slot, node(f"g{to}", "param x"), "ARG_TO_PARAM", "static", "c.py", k + 1, 1, "x"))
    edges.append((node("g5", "arg 0", 6), node("g50", "param x"), "ARG_TO_PARAM", "static", "c.py", 6, 1, "x"))
    edges.append((node("g45", "arg 0", 46), node("g70", "param x"), "ARG_TO_PARAM", "static", "c.py", 46, 1, "x"))
    nodes = sorted({n for e in edges for n in e[:2]})
    table, values = spark.createDataFrame(edges, COLUMNS), spark.createDataFrame([(n,) for n in nodes], "node string")
    known, whole = flow.summaries(table)
    assert whole
    ways = [tuple(r) for r in flow._ways(table, known, True, flow._local(table)).collect()]
    got = collections.defaultdict(dict)
    for r in flow.matched_impact(table, values, known=known).collect():
        assert r["limit"] is None and r["node"] not in got[r["seed"]]
        got[r["seed"]][r["node"]] = r["distance"]
    assert got == {n: spread(ways, n) for n in nodes} and max(got[node("g0", "param x")].values()) == 79
