"""Work that must not grow faster than its input."""

from pyspark.sql import functions as F

from tessera.operators import relations


def most_rows(spark) -> int:
    """The largest number of rows that an operator of the last query put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    values = store.executionMetrics(last.executionId())
    rows = [0]
    metrics = last.metrics()
    for k in range(metrics.size()):
        m = metrics.apply(k)
        if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
            rows.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return max(rows)


def test_selectors_of_a_common_name_do_not_meet_every_symbol_one_by_one(spark):
    n = 1500
    k = F.col("id")
    symbols = spark.range(n).select(
        F.format_string("s%04d", k).alias("symbol_id"), F.format_string("p%04d", k).alias("path"), F.lit("q").alias("qualname"), F.lit("run").alias("name"),
        F.when(k % 2 == 0, "class").otherwise("function").alias("kind"), (k % 20).cast("long").alias("start_line"), (k % 20 + k % 3).cast("long").alias("end_line"),
    )
    void = F.lit(None).cast("string")
    asks = spark.range(n).select(
        k.alias("ask"), void.alias("symbol_id"), F.when(k == 7, "p0007").alias("path"), F.when(k == 8, "q").alias("qualname"), F.lit("run").alias("name"),
        F.when(k % 2 == 1, "class").alias("kind"), F.when(k % 5 == 0, F.lit(4)).alias("line"),
    )
    told = {r["ask"]: r for r in relations.select_symbols(symbols, asks).collect()}
    assert most_rows(spark) < 50 * n
    assert len(told) == n
    assert told[2]["candidates"] == n and told[2]["status"] == "ambiguous" and told[2]["first"] == [f"s{i:04d}" for i in range(10)]
    assert told[1]["candidates"] == n // 2 and told[1]["first"][:2] == ["s0000", "s0002"]
    assert told[7]["status"] == "not_found" and told[8]["candidates"] == n
    inner = [i for i in range(n) if i % 20 == 4 and i % 3 == 0]
    assert told[10]["candidates"] == len(inner) and told[10]["first"] == [f"s{i:04d}" for i in inner[:10]]


def test_facts_are_made_of_a_bounded_piece_of_a_batch_at_a_time():
    import pyarrow as pa

    from tessera.extract.python_facts import PIECE_BYTES, pieces

    text = ["x" * (PIECE_BYTES // 3), "y" * (2 * PIECE_BYTES), None, "", *["z" * 1000] * 200]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(text))]), pa.array(text)], ["path", "content"])
    parts = list(pieces(batch))
    assert [c for p in parts for c in p.column(1).to_pylist()] == text
    assert all(len(p) == 1 or sum(len(c or "") for c in p.column(1).to_pylist()) <= PIECE_BYTES for p in parts)
    assert not list(pieces(batch.slice(0, 0)))


def test_names_of_a_file_are_looked_up_with_one_shuffle(spark):
    from tessera import bind
    from tessera.extract.python_facts import BINDING_LISTS, extract

    files = [("src/a.py", "import b\nfrom b import f\nclass C:\n    def m(self): f(); self.m()\ndef g(c: C): c.m(); b.f()\n"), ("src/b.py", "def f(): pass\n")]
    facts = extract(spark.createDataFrame(files, "path string, content string"), BINDING_LISTS)
    looked = bind._nearest(bind._asks(facts))
    plan = looked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    calls = {r["name"]: (r["resolution"], r["target_qualname"]) for r in bind.relations(facts).where("kind = 'CALL'").collect()}
    assert calls == {"f": ("resolved", "f"), "self.m": ("resolved", "C.m"), "c.m": ("resolved", "C.m"), "b.f": ("resolved", "f")}


def test_pointers_of_lineage_carry_no_names_and_stop_at_the_first_touch(spark, monkeypatch):
    from tessera.operators import tasks

    written = []
    monkeypatch.setattr(tasks, "materialize", lambda df, name, real=tasks.materialize: written.append((name, df.columns)) or real(df, name))
    touches = [(1, k, f"n{k}", f"n{k + 1}") for k in range(5)] + [(1, 9, None, "x"), (2, 1, "n0", "y")]
    got = {tuple(r) for r in tasks.lineage(spark.createDataFrame(touches, "task long, seq long, source string, target string")).select("task", "origin", "current", "conflict").collect()}
    assert got == {(1, "n0", "n5", False), (1, None, "x", False), (2, "n0", "y", False)}
    assert all(name == "lineage" or not {"source", "target"} & set(columns) for name, columns in written)
    assert sum("source" in columns for _, columns in written) == 1


def test_walks_send_lists_of_neighbours_not_a_row_for_each(spark):
    """Rows that all exchanges of a walk write, where a node has a hundred neighbours."""
    from tessera.operators import graph

    n, degree = 2000, 100
    edges = spark.range(n * degree).select(F.format_string("n%d", F.col("id") % n).alias("src"), F.format_string("n%d", (F.col("id") * 7919 + F.floor(F.col("id") / n)) % n).alias("tgt"))
    seeds = spark.range(40).select(F.format_string("n%d", F.col("id")).alias("node"))

    store = spark._jsparkSession.sharedState().statusStore()

    def sent(walk) -> int:
        before = store.executionsList().last().executionId() if store.executionsCount() else -1
        walk().write.format("noop").mode("overwrite").save()
        written, runs = {}, store.executionsList()
        for run in (runs.apply(k) for k in range(runs.size())):
            if run.executionId() > before:
                values, metrics = store.executionMetrics(run.executionId()), run.metrics()
                ids = {metrics.apply(k).accumulatorId() for k in range(metrics.size()) if metrics.apply(k).name() == "shuffle records written"}
                written.update({i: int(values.apply(i).replace(",", "")) for i in ids if values.contains(i)})
        return sum(written.values())

    assert edges.distinct().count() == n * degree
    # 40 seeds meet 400,000 neighbours on their second step.
    most = 5 * n * degree // 2
    a, b = sent(lambda: graph.distances(edges, seeds, 2)), sent(lambda: graph.shortest_paths_from(edges, seeds, 2))
    assert a < most and b < most, (a, b)


def test_value_flow_binds_calls_only_and_moves_no_ids(spark, monkeypatch):
    from tessera import bind
    from tessera.extract.python_facts import extract
    from tessera.operators import flow

    names = [f"m{k}" for k in range(40)]
    files = [(f"src/{n}.py", "".join(f"from {m} import {m}\n" for m in names if m != n) + f"def {n}(v: int):\n" + "".join(f"    v = {m}(v)\n" for m in names) + "    return v\n") for n in names]
    facts = extract(spark.createDataFrame(files, "path string, content string")).localCheckpoint()
    written = {}

    def count(df, name, *rest, real=bind.materialize):
        made = real(df, name, *rest)
        written[name] = (made.count(), [f"{k} {v}" for k, v in made.dtypes])
        return made

    monkeypatch.setattr(bind, "materialize", count)
    rows = lambda df: sorted(map(tuple, df.collect()))
    calls = len(names) ** 2
    edges = rows(flow.flow_edges(facts, bind.bound_calls(facts)))
    assert written["looked-up"][0] == written["bound"][0] == calls
    assert not any("symbol_id" in c or "id:" in c for name in ("exports-0", "looked-up", "bound") for c in written[name][1])
    assert edges == rows(flow.flow_edges(facts, bind.relations(facts))) and sum(e[2] == "ARG_TO_PARAM" for e in edges) == calls


def test_windows_of_the_network_use_their_arrays_again():
    import numpy as np

    from tessera.llm import gru

    draw = np.random.default_rng(4)
    p, room = gru.initial(8, 8, 24, 16, np.ones(64)), gru._Room()
    ids, target, keep = draw.integers(0, 64, (20, 512)), draw.integers(0, 64, (20, 512)), np.ones((20, 512), bool)
    keep[:, ::7], h = False, np.zeros((512, 24), np.float32)
    first = gru.window_gradients(p, ids, keep, target, keep, h, room)
    held = {k: id(v) for k, v in room.held.items()}
    other = gru.window_gradients(p, ids[:, :300], keep[:, :300], target[:, :300], keep[:, :300], h[:300], room)
    again = gru.window_gradients(p, ids, keep, target, keep, h, room)
    assert held and held == {k: id(v) for k, v in room.held.items()}
    assert all(np.array_equal(first[0][k], again[0][k]) for k in p) and first[1] == again[1] and np.array_equal(first[2], again[2])
    fresh = gru.window_gradients(p, ids[:, :300], keep[:, :300], target[:, :300], keep[:, :300], h[:300])
    assert all(np.allclose(other[0][k], fresh[0][k], atol=1e-7) for k in p)


def test_words_of_a_batch_are_split_at_once_and_are_the_tokens_of_its_texts(monkeypatch):
    import pyarrow as pa

    from tessera.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "PIECE_BYTES", 40)
    texts = [None, "", " \t\n", "A b\x0bC\x0c d\r\n", "  Ärger É x \x1c y\x85z ", "w" * 100, "q Q q", *["one two"] * 20]
    found, ends = [[] for _ in texts], []
    for first, end, words, owner in lm_scoring.words_of(pa.array(["unread", *texts], pa.string()).slice(1)):
        ends.append(end)
        for word, k in zip(words.to_pylist(), owner.tolist(), strict=True):
            found[first + k].append(word)
    assert found == [lm_scoring.tokens(t) for t in texts] and ends[-1] == len(texts) and len(ends) > 4


def test_few_values_of_a_walk_are_sent_to_the_lists(spark, monkeypatch):
    from tessera.operators import graph

    sent = []
    monkeypatch.setattr(graph, "maybe_broadcast", lambda df, rows: sent.append(rows) or F.broadcast(df))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "src string, tgt string")
    got = {tuple(r) for r in graph.distances(edges, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 2)} and sent and max(sent) == 1


def test_rebinding_parses_edited_texts_only_in_all_parts_and_looks_up_each_reference_once(spark, monkeypatch):
    from conftest import SMALL

    from tessera import bind, queries
    from tessera.extract.python_facts import BINDING_LISTS, extract
    from tessera.plans import standins

    files = standins.python_files(spark, SMALL)
    assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    code = "import b\nfrom .b import f as g\nclass C:\n    def m(self, c: C): c.m.x(); g()\n"
    facts = extract(spark.createDataFrame([("src/p/a.py", code)], "path string, content string"), BINDING_LISTS).localCheckpoint()
    entries = bind._asks(facts)
    assert entries.where("ref is not null").count() == facts.selectExpr("size(references)").first()[0]
    read = bind.reads_of(facts)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    keys = {r["key"] for r in read.collect()}
    assert {"module:p.b", "export:p.b:f", "member:p:b:f", "top:b", "module:C", "export:C:m", "member:C:m:x", "module:b"} - keys == {"module:C", "export:C:m", "member:C:m:x"}
    parsed = []
    monkeypatch.setattr(queries, "materialize", lambda df, name, real=queries.materialize: (made := real(df, name), parsed.append((name, made.count())))[0])
    got = queries.QUERIES["rebinding"](spark, SMALL)
    assert dict(parsed) == {"python-files": 150, "edited-facts": 3} and got.where("bound_anew").select("source_path").distinct().count() > 3
