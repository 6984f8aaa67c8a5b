import pytest
from conftest import SMALL
from oracle import assert_same, connect

from tessera.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    assert_same(spark, con, QUERIES[name], ORACLE_SQL[name], SMALL)


def test_queries_without_sql_are_tested_below():
    assert set(QUERIES) - set(ORACLE_SQL) == {"unified_patch", "value_flow_edges", "value_flow_impact", "value_flow_matched"}


def test_patches_are_those_of_a_plain_diff(spark, con):
    import difflib

    text = dict(con.sql("SELECT source || '/' || doc_id, text FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0").fetchall())
    got = QUERIES["unified_patch"](spark, SMALL).collect()
    assert {r["path"] for r in got} == set(text)
    for r in got:
        new, added = text[r["path"]], int(r["path"].split("/")[1]) % 10 == 0
        old = "" if added else new + "x"
        plain = list(difflib.unified_diff(old.splitlines(True), new.splitlines(True), "/dev/null" if added else f"a/{r['path']}", f"b/{r['path']}"))
        whole = "".join(x if x.endswith("\n") else x + "\n\\ No newline at end of file\n" for x in plain)
        assert r["complete"] == (len(whole) <= 20_000) and whole.startswith(r["patch"]) and (not r["complete"] or r["patch"] == whole)


def test_value_flow_impact_is_what_a_plain_walk_reaches(spark):
    edges, after = QUERIES["value_flow_edges"](spark, SMALL).collect(), {}
    assert len({tuple(e) for e in edges}) == len(edges) > 0
    for e in edges:
        after.setdefault(e["source"], set()).add(e["target"])
    got = {(r["seed"], r["node"]): r["distance"] for r in QUERIES["value_flow_impact"](spark, SMALL).collect()}
    for seed in {s for s, _ in got}:
        layer, seen = {seed}, {seed: 0}
        for k in range(1, 6):
            layer = {t for n in layer for t in after.get(n, ())} - seen.keys()
            seen |= dict.fromkeys(layer, k)
        assert seen == {n: d for (s, n), d in got.items() if s == seed}


def test_matched_flow_is_that_of_walks_with_a_stack(spark):
    from test_flow import walks

    edges = [tuple(e) for e in QUERIES["value_flow_edges"](spark, SMALL).select("source", "target", "kind", "resolution", "path", "line", "column", "basis").collect()]
    edges = [(*e[:5], (e[4], e[5], e[6]), 0, e[7]) for e in edges]
    rows, got = QUERIES["value_flow_matched"](spark, SMALL).collect(), {}
    for r in rows:
        got.setdefault(r["seed"], {})[r["node"]] = r["distance"]
    whole = {r["seed"] for r in rows if r["limit"] is None}
    assert got
    for seed, reached in got.items():
        want = walks(edges, seed)
        assert set(reached) <= want and (seed not in whole or set(reached) == want) and max(reached.values()) <= 8


def test_matched_flow_goes_to_the_end_of_every_walk(spark):
    from test_flow import spread

    from tessera.operators import flow

    edges = QUERIES["value_flow_edges"](spark, SMALL).localCheckpoint()
    ways = [tuple(r) for r in flow._ways(edges, flow.summaries(edges)[0], True, flow._local(edges)).collect()]
    rows, got = QUERIES["value_flow_matched"](spark, SMALL).collect(), {}
    for r in rows:
        got.setdefault(r["seed"], {})[r["node"]] = r["distance"]
    assert all(r["limit"] is None for r in rows) and sum(map(len, got.values())) == len(rows)
    assert got == {seed: spread(ways, seed) for seed in got} and max(max(d.values()) for d in got.values()) > 8


def test_entry_registers_everything():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
