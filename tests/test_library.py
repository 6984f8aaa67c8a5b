"""Behaviour on small sources, and graph operators against plain Python."""

import collections
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera import bind
from tessera.extract.python_facts import extract, extract_new, python_facts
from tessera.functions import policy
from tessera.functions.text import contains_folded, parent_dirs, physical_lines, split_lines, symbol_id
from tessera.operators import coverage, dependencies, diff, flow, graph, journal, relations, search
from tessera.plans.api import Project
from tessera.plans.render import Cursors, analysis_mode, clip, largest_fitting, shared_budget, symbol_graph
from tessera.sources import scan
from tessera.sources.snapshots import Overtaken, SnapshotStore
from tessera.streaming import cdc


FILE_ROWS = "path string, content string"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\n", "a\r\nb", "\n", "a\rb\n", "a\r\n"])
def test_physical_lines(spark, text):
    want = text.split("\n")
    want = [x.removesuffix("\r") for x in (want[:-1] if text == "" or text.endswith("\n") else want)]
    assert one(spark, physical_lines, text) == want


@pytest.mark.parametrize("text", ["a\u2028b", "a\x0bb\x0c", "x\r\ny\rz\n", "\x85a", "a\x1cb"])
def test_split_lines_is_like_splitlines(spark, text):
    assert one(spark, split_lines, text) == text.splitlines()


def test_folding_is_ascii_only(spark):
    assert one(spark, lambda v: contains_folded(v, "AbC"), "xxaBcyy") and not one(spark, lambda v: contains_folded(v, "É"), "é")


def test_symbol_id_formula(spark):
    got = spark.range(1).select(symbol_id(F.lit("a/b.py"), F.lit("C.f"), F.lit(7))).first()[0]
    assert got == "sym_" + hashlib.sha256(b"a/b.py\0C.f\x007").hexdigest()[:32]


def test_parent_dirs(spark):
    assert one(spark, parent_dirs, "a/b/c.py") == ["a/b", "a", "."] and one(spark, parent_dirs, "c.py") == ["."]


@pytest.mark.parametrize(("path", "ok"), [("a/b.py", True), ("/a", False), ("a//b", False), ("a/../b", False), ("a/", False), ("", False), ("a\\b", False), ("c:x", False), ("a\tb", False), ("..a/b", True)])
def test_valid_path(spark, path, ok):
    assert one(spark, policy.valid_path, path) is ok


@pytest.mark.parametrize(("path", "out"), [("a/NODE_MODULES/x", True), ("a/.env.local", True), ("k/id_rsa.pub", True), ("src/app.py", False), ("a/x.SQLITE3", True), ("target.py", False)])
def test_excluded_path(spark, path, out):
    assert one(spark, policy.excluded_path, path) is out


def test_content_problem(spark):
    assert one(spark, policy.content_problem, "x = 1") is None
    assert one(spark, policy.content_problem, "a\nDB_PASSWORD=hunter2") == "possible credential or private key"
    assert one(spark, policy.content_problem, "password: ${SECRET}") is None
    assert one(spark, policy.content_problem, "a\0b") == "binary content"


def test_language(spark):
    assert one(spark, policy.language, "a/B.PY") == "python" and one(spark, policy.language, "a.b/.py") == "unsupported"
    assert one(spark, policy.structure_language, "x.rs") == "unsupported"


def test_scan_tree_and_budget(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "b/c.txt": "é".encode(), "b/d.bin": b"\xff\xfe", "build/e.py": b"", "f+g %41.txt": b"z"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"]: r for r in scan.scan_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.py", "b/c.txt", "b/d.bin", "f+g %41.txt"}
    assert got["b/d.bin"]["problem"] == "invalid UTF-8 text" and got["b/c.txt"]["content"] == "é"
    with pytest.raises(ValueError, match="limit"):
        scan.check_budget(scan.scan_tree(spark, str(tmp_path)), max_files=2)


def test_ignore_rules(spark):
    rules = scan.ignore_rules("# c\n*.log\n!keep.log\n/only\nlogs/\nsrc/**/tmp\n")
    want = {"a.log": True, "x/keep.log": False, "only": True, "x/only": False, "logs/keep.log": True, "src/a/b/tmp": True, "src/tmp": True, "a.py": False}
    df = spark.createDataFrame([(p,) for p in want], "p string").select("p", scan.ignored(F.col("p"), rules).alias("i"))
    assert {r["p"]: r["i"] for r in df.collect()} == want


def test_projects(spark):
    paths = ["one/pyproject.toml", "one/sub/pom.xml", "one/vend/.git/HEAD", "two/build.gradle", "readme"]
    got = {r["root"] for r in scan.discover_projects(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {"one", "one/vend", "two"}
    named = spark.createDataFrame([("p1", "App", "org/App", ["x"]), ("p2", "Apple", "org/Apple", None)], "project_id string, display_name string, qualified_name string, aliases array<string>")
    assert [tuple(r) for r in scan.resolve_names(named, "App").collect()] == [("p1", "exact")]
    assert {tuple(r) for r in scan.resolve_names(named, "app").collect()} == {("p1", "candidate"), ("p2", "candidate")}


SOURCES = {
    "pkg/__init__.py": "from .base import Base\n",
    "pkg/base.py": "class Base:\n    def go(self):\n        return self.stop()\n    def stop(self):\n        return 1\n",
    "app.py": "import json\nfrom pkg import Base as B\nimport pkg.base\nimport pkg.missing\n\nclass Child(B):\n    pass\n\ndef run(x):\n    b = Child()\n    y = helper(x)\n    pkg.base.Base()\n    return json.dumps(y)\n\ndef helper(v):\n    return v\n\ndef shadow(helper):\n    return helper(1)\n",
    "twice.py": "def f():\n    pass\ndef f():\n    pass\ng = f()\n",
    "bad.py": "def (\n",
}


@pytest.fixture(scope="module")
def project(spark):
    rows = [(p, c, hashlib.sha256(c.encode()).hexdigest(), len(c), "python") for p, c in SOURCES.items()]
    return Project(spark.createDataFrame(rows, "path string, content string, sha256 string, size long, language string"))


def test_binding_never_guesses(project):
    got = {(r["source_path"], r["source_qualname"], r["kind"], r["name"]): (r["resolution"], r["target_path"], r["target_qualname"]) for r in project.relations.collect()}
    assert got["app.py", "", "INHERITANCE", "B"] == ("resolved", "pkg/base.py", "Base")
    assert got["app.py", "run", "INSTANTIATION", "Child"] == ("resolved", "app.py", "Child")
    assert got["app.py", "run", "CALL", "helper"] == ("resolved", "app.py", "helper")
    assert got["app.py", "run", "INSTANTIATION", "pkg.base.Base"] == ("resolved", "pkg/base.py", "Base")
    assert got["app.py", "run", "CALL", "json.dumps"][0] == "external_or_unavailable"
    assert got["app.py", "", "IMPORT", "pkg.missing"][0] == "unavailable"
    assert got["app.py", "shadow", "CALL", "helper"] == ("unresolved", None, None)
    assert got["pkg/base.py", "Base.go", "CALL", "self.stop"] == ("resolved", "pkg/base.py", "Base.stop")
    assert got["twice.py", "", "CALL", "f"] == ("ambiguous", None, None)
    assert got["pkg/base.py", "Base", "CONTAINS", "go"] == ("resolved", "pkg/base.py", "Base.go")


def test_statuses_and_coverage(project):
    assert {r["path"]: r["status"] for r in project.facts.collect()}["bad.py"] == "parse_error"
    assert project.index_coverage().first().asDict() == {"known": 5, "ready": 4, "limited": 1, "unindexed": 0}


def test_project_queries(project):
    ids = {r["qualname"]: r["symbol_id"] for r in project.symbols.where("path = 'app.py'").collect()}
    assert project.find_references(ids["helper"]).count() == 1
    found = project.call_graph(ids["run"], depth=2)
    assert {n["id"] for n in found["nodes"]} >= {ids["run"], ids["helper"], ids["Child"]} and not found["truncated"]
    assert project.call_graph(ids["run"], max_edges=1)["truncated"]
    chain = {r["node"]: r["chain"] for r in project.file_dependencies("app.py", 2).collect()}
    assert chain["pkg/base.py"] == ["app.py", "pkg/base.py"]
    assert {r["node"] for r in project.impact("pkg/base.py").collect()} == {"pkg/base.py", "app.py", "pkg/__init__.py"}
    layer = {r["node"]: r["layer"] for r in project.architecture().collect()}
    assert layer["pkg/base.py"] == 0 and layer["app.py"] >= 1
    assert project.call_paths(ids["run"], ids["helper"]).first()["length"] == 1
    kinds = {r["module"]: r["dependency_kind"] for r in project.external_dependencies().collect()}
    assert kinds == {"json": "standard_library", "pkg.missing": "local_module"}
    assert [r["text"] for r in project.read_symbol(ids["helper"]).orderBy("line").collect()] == ["def helper(v):", "    return v"]


def test_search_pages_cover_everything_once(project):
    seen, cursor = [], None
    while True:
        page = project.search_code("e", limit=4, cursor=cursor)
        seen += [(m["path"], m["line"]) for m in page["matches"]]
        cursor = page.get("cursor")
        if not cursor:
            break
    want = sorted((p, k + 1) for p, c in SOURCES.items() for k, line in enumerate(c.split("\n")) if "e" in line)
    assert seen == want


def test_value_flow(project):
    edges = project.value_flow()
    start = edges.sparkSession.createDataFrame([(flow.parameter("app.py", "run", "x"),)], "node string")
    reached = {r["node"] for r in flow.impact(edges, start, 5).collect()}
    assert flow.parameter("app.py", "helper", "v") in reached
    back = edges.sparkSession.createDataFrame([(flow.returned("app.py", "helper"),)], "node string")
    assert flow.parameter("app.py", "run", "x") in {r["node"] for r in flow.origin(edges, back, 5).collect()}


def test_assignment_kills_and_branches_join():
    flows = python_facts("m.py", "def f(a, b, c):\n    x = a\n    x = b\n    if c:\n        y = x\n    else:\n        y = c\n    return y\n")[9]
    into = collections.defaultdict(set)
    for s, t, *_ in flows:
        into[t].add(s)

    def origins(node):
        return {node} if node not in into else set().union(*(origins(s) for s in into[node]))

    assert origins("f|return|0|0") == {"f|param b|0|0", "f|param c|0|0"}


def test_parse_reuse(spark, project):
    cache = project.facts.join(project.files.select("path", "sha256"), "path")
    again = extract_new(project.files.select("path", "sha256", "content"), cache)
    assert again.count() == len(SOURCES)


def edge_frame(spark, pairs):
    return spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, tgt string")


def reach(pairs, start):
    out, todo = set(), [start]
    while todo:
        for a, b in pairs:
            if a == todo[0] and b not in out:
                out.add(b)
                todo.append(b)
        todo.pop(0)
    return out


@pytest.mark.parametrize(("seed", "local"), [(1, 0), (2, 12), (3, 1000)])
def test_components_and_layers_on_random_graphs(spark, seed, local):
    r = random.Random(seed)
    pairs = sorted({(r.randrange(30), r.randrange(30)) for _ in range(45)})
    nodes = {x for p in pairs for x in p}
    ahead = {n: reach(pairs, n) for n in nodes}
    same = lambda a, b: a == b or (b in ahead[a] and a in ahead[b])
    got = {row["node"]: row for row in graph.layers(edge_frame(spark, pairs), local).collect()}
    for a, b in itertools.combinations(nodes, 2):
        assert (got[str(a)]["scc"] == got[str(b)]["scc"]) == same(a, b)
    level = {}

    def layer(n):
        if n not in level:
            group = [m for m in nodes if same(n, m)]
            level[n] = max((1 + layer(t) for s, t in pairs if s in group and t not in group), default=0)
        return level[n]

    assert {n: got[str(n)]["layer"] for n in nodes} == {n: layer(n) for n in nodes}
    assert {n for n in nodes if got[str(n)]["cyclic"]} == {n for n in nodes if n in ahead[n]}


def test_shortest_paths_on_random_graph(spark):
    r = random.Random(3)
    pairs = sorted({(r.randrange(15), r.randrange(15)) for _ in range(40)})
    want = []
    for a, b in [(0, 5), (1, 7), (2, 9), (3, 3)]:
        paths = [[a]]
        for _ in range(5):
            if any(p[-1] == b for p in paths):
                break
            paths = [[*p, t] for p in paths for s, t in pairs if s == p[-1]]
        want += [[str(x) for x in p] for p in paths if p[-1] == b]
    ask = spark.createDataFrame([("0", "5"), ("1", "7"), ("2", "9"), ("3", "3")], "source string, target string")
    got = [x["path"] for x in graph.shortest_paths(edge_frame(spark, pairs), ask, 5, most=1000).collect()]
    assert sorted(got) == sorted(map(list, {tuple(p) for p in want}))


@pytest.mark.parametrize("most", [2, 1000])
def test_first_paths_to_every_node(spark, most):
    r = random.Random(5)
    pairs = sorted({(r.randrange(12), r.randrange(12)) for _ in range(45)})
    want = []
    for a in (0, 3):
        seen, layer = {a}, [[a]]
        want.append([str(a)])
        for _ in range(4):
            layer = [[*p, t] for p in layer for s, t in pairs if s == p[-1] and t not in seen]
            seen |= {p[-1] for p in layer}
            for t in {p[-1] for p in layer}:
                want += sorted([str(x) for x in p] for p in layer if p[-1] == t)[:most]
    found = graph.shortest_paths_from(edge_frame(spark, pairs), spark.createDataFrame([("0",), ("3",)], "node string"), 4, most).collect()
    assert sorted(x["path"] for x in found) == sorted(want)
    assert all((x["source"], x["target"], x["length"]) == (x["path"][0], x["path"][-1], len(x["path"]) - 1) for x in found)


def test_frontier_counts_a_self_edge_once(spark):
    rows = [(1, "a", "s", "s", "p", "p", "CALL", 1), (2, "b", "s", "t", "p", "q", "CALL", 2)]
    df = spark.createDataFrame(rows, "fact_order long, name string, source_symbol_id string, target_symbol_id string, source_path string, target_path string, kind string, line int")
    got = relations.frontier_edges(df, spark.createDataFrame([("s",)], "node string"), ("CALL",), 5).collect()
    assert sorted((r["side"], r["line"]) for r in got) == [("out", 1), ("out", 2)]


def test_snapshot_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    change = lambda *rows: spark.createDataFrame(rows, cdc.CHANGES)
    full = change(("upsert", "a", "1"), ("upsert", "b", "2"))
    assert store.apply("p", "r1", 0, "full", full) == 1 and store.apply("p", "r1", 0, "full", full) == 1
    with pytest.raises(ValueError, match="another payload"):
        store.apply("p", "r1", 0, "full", change(("upsert", "a", "9")))
    with pytest.raises(ValueError, match="base revision"):
        store.apply("p", "r2", 0, "delta", full)
    with pytest.raises(ValueError, match="full"):
        store.apply("p", "r2", 1, "full", full)
    assert store.apply("p", "r2", 1, "delta", change(("delete", "a", None), ("upsert", "c", "2"))) == 2
    assert {r["path"] for r in store.files("p", 2).collect()} == {"b", "c"} and store.blobs().count() == 2
    with pytest.raises(KeyError):
        store.revision("p", "ctx_unknown")


@pytest.mark.parametrize("stop", range(1, 4))
def test_a_publication_that_stops_can_be_repeated(spark, tmp_path, monkeypatch, stop):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    change = lambda *rows: spark.createDataFrame(rows, cdc.CHANGES)
    store.apply("p", "r1", 0, "full", change(("upsert", "a", "1")))
    writer, done = type(spark.range(1).write), []
    parquet = writer.parquet

    def stopped(self, path, *a, **k):
        if len(done) == stop - 1:
            raise OSError("stopped")
        done.append(path)
        return parquet(self, path, *a, **k)

    second = change(("upsert", "b", "2"), ("upsert", "c", "1"))
    def refused(self, ready):
        raise OSError("stopped")

    monkeypatch.setattr(writer, "parquet", stopped)
    with monkeypatch.context() as m:
        if stop == 3:
            m.setattr(SnapshotStore, "commit", refused)
        with pytest.raises(OSError, match="stopped"):
            store.apply("p", "r2", 1, "delta", second)
    monkeypatch.setattr(writer, "parquet", parquet)
    assert store.revision("p") == 1 and store.published("p", "r2") is None
    assert store.apply("p", "r2", 1, "delta", second) == 2 == store.apply("p", "r2", 1, "delta", second)
    assert sorted(r["path"] for r in store.files("p", 2).collect()) == ["a", "b", "c"] and store.blobs().count() == 2


def test_a_small_change_writes_few_buckets(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), 16)
    change = lambda *rows: spark.createDataFrame(rows, cdc.CHANGES)
    store.apply("p", "r1", 0, "full", change(*(("upsert", f"f{k}", str(k % 50)) for k in range(400))))
    store.apply("p", "r2", 1, "delta", change(("upsert", "f7", "new"), ("delete", "f8", None)))
    first, second = (r["folders"] for r in store.pointers("p").orderBy("revision").collect())
    assert len(first) == 16 and 1 <= len({b for b, f in second.items() if f != first[b]}) <= 2
    files = {r["path"]: r["sha256"] for r in store.files("p", 2).collect()}
    assert set(files) == {f"f{k}" for k in range(400)} - {"f8"} and files["f7"] == hashlib.sha256(b"new").hexdigest()
    assert store.files("p", 1).count() == 400 and store.blobs().count() == 51
    lone = SnapshotStore(spark, str(tmp_path / "t"), 16)
    lone.apply("p", "r1", 0, "full", change(("upsert", "a", "1")))
    assert lone.apply("p", "r2", 1, "delta", change(("delete", "a", None))) == 2 and lone.files("p", 2).count() == 0


def test_of_two_writers_one_is_refused(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), 4)
    change = lambda *rows: spark.createDataFrame(rows, cdc.CHANGES)
    store.apply("p", "r1", 0, "full", change(("upsert", "a", "1")))
    one, two = (store.prepare("p", r, 1, "delta", change(("upsert", r, "2"))) for r in ("r2", "r3"))
    assert store.commit(one) == 2
    with pytest.raises(Overtaken):
        store.commit(two)
    assert {r["path"] for r in store.files("p", 2).collect()} == {"a", "r2"} and store.published("p", "r3") is None
    assert store.apply("p", "r3", 2, "delta", change(("upsert", "r3", "2"))) == 3


def test_change_stream_equals_batch(spark, tmp_path):
    import json

    (tmp_path / "in").mkdir()
    records = [("p", 1, "upsert", "a", "1"), ("p", 2, "upsert", "a", "2"), ("p", 3, "upsert", "b", "3"), ("q", 1, "upsert", "a", "4")]
    names = ("project_id", "seq", "op", "path", "content")
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in records))
    store = SnapshotStore(spark, str(tmp_path / "s"))
    for _ in range(2):
        cdc.apply_changes(cdc.change_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "c")).awaitTermination()
    assert store.revision("p") == store.revision("q") == 1 and {r["path"] for r in store.files("p", 1).collect()} == {"a", "b"}
    assert store.files("p", 1).where("path = 'a'").first()["sha256"] == hashlib.sha256(b"2").hexdigest()


def test_idle_stream_matches_batch(spark, tmp_path):
    events = spark.sql("SELECT k, timestamp'2024-01-01' + make_interval(0,0,0,0,0,0, id * gap) AS ts FROM range(20) CROSS JOIN VALUES ('a', 100), ('b', 400) AS t(k, gap)")
    events.write.parquet(str(tmp_path / "e"))
    stream = cdc.idle_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "k", "ts")
    stream.writeStream.format("memory").queryName("idle").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["k"], r["events"]) for r in spark.table("idle").collect())
    want = sorted((r["k"], r["events"]) for r in journal.idle_sessions(events, "k", "ts").collect())
    assert got == want and len(got) == 21


def test_log_ranges_keep_characters_whole(spark):
    text = "aé漢😀z" * 3
    data = text.encode()
    df = spark.createDataFrame([("j", 0, data[:10]), ("j", 1, data[10:])], "job_id string, seq long, data binary")
    cursor, out = 0, b""
    while cursor < len(data):
        part = b"".join(bytes(r["data"]) for r in journal.read_range(df.groupBy("job_id").agg(F.lit(0).cast("long").alias("seq"), F.lit(data).alias("data")), cursor, 5).collect())
        part.decode()
        out, cursor = out + part, cursor + len(part)
    assert out == data
    assert [r["start"] for r in journal.with_offsets(df).orderBy("seq").collect()] == [0, 10]


def test_diff_and_edits(spark):
    old, new = "a\nb\nc\n", "a\nx\nc\nd\n"
    df = spark.createDataFrame([("f", old, new), ("g", None, "1\n")], "path string, old string, new string")
    assert {tuple(r) for r in diff.line_counts(df).collect()} == {("f", 2, 1), ("g", 1, 0)}
    patch = {r["path"]: r for r in diff.patches(df).collect()}
    assert patch["f"]["complete"] and "-b\n+x\n" in patch["f"]["patch"] and patch["g"]["patch"].startswith("--- /dev/null")
    assert not diff.bounded_patch("f", old, new, 20)[1]
    assert diff.apply_edit(old, "insert_lines", start=2, new="n") == "a\nn\nb\nc\n"
    assert diff.apply_edit(old, "replace_lines", start=1, end=2, new="z\n") == "z\nc\n"
    with pytest.raises(ValueError):
        diff.apply_edit("aaa", "replace_fragment", old="aa", new="b")


def test_manifests_and_classes(spark):
    files = {"pyproject.toml": '[project]\ndependencies = ["PyYAML>=6", "requests[x]"]\n', "sub/requirements.txt": "numpy==1 # n\n-r other\n", "j/pom.xml": "<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency></dependencies></project>"}
    found = dependencies.declarations(spark.createDataFrame(list(files.items()), "path string, content string"))
    assert {(r["directory"], r["name"]) for r in found.collect()} == {(".", "pyyaml"), (".", "requests"), ("sub", "numpy"), ("j", "g:a")}
    rows = [("a.py", "yaml", 1, "python", None, "yaml"), ("sub/b.py", "yaml", 1, "python", None, "yaml"), ("a.py", "os.path", 2, "python", None, "os.path")]
    imports = spark.createDataFrame(rows, "path string, name string, line int, language string, target_path string, module string")
    got = {(r["path"], r["module"]): r["dependency_kind"] for r in dependencies.classify(imports, found, spark.createDataFrame([("pkg.x",)], "module string")).collect()}
    assert got == {("a.py", "yaml"): "third_party", ("sub/b.py", "yaml"): "unknown", ("a.py", "os.path"): "standard_library"}


def test_what_manifests_leave_out_is_told(spark):
    many = "".join(f"name{k}\n" for k in range(600))
    files = {"a/requirements.txt": many, "b/requirements.txt": "x\n" * 40_000, "c/pyproject.toml": "[project\n", "d/requirements.txt": "fine\n"}
    found = dependencies.declarations(spark.createDataFrame(list(files.items()), FILE_ROWS)).collect()
    told = {(r["directory"], r["name"]) for r in found if r["kind"] == dependencies.DIAGNOSTIC}
    assert told == {("a", "TOO_MANY_DECLARATIONS"), ("b", "MANIFEST_TOO_LARGE"), ("c", "MANIFEST_INVALID")}
    assert sum(r["directory"] == "a" for r in found) == 513 and sum(r["directory"] == "d" for r in found) == 1


def test_continuation(spark):
    df = spark.createDataFrame([("f", "abc\ndefgh\nij\n")], "path string, content string")
    page = [tuple(r) for r in search.source_page(df, 1, 3, 7).orderBy("line").collect()]
    assert page == [("f", 1, "abc"), ("f", 2, "def")]
    assert tuple(search.continuation(df, 1, 3, 7).first()) == ("f", 2, 3)
    assert [tuple(r) for r in search.source_page(df, 2, 3, 20, 3).orderBy("line").collect()] == [("f", 2, "gh"), ("f", 3, "ij")]


def test_rendering():
    cursors = Cursors()
    text = cursors.encode(("a", 3), "q", now=1000)
    assert cursors.decode(text, "q", now=1500) == ("a", 3)
    for bad in (("p", 1500), ("q", 2000)):
        with pytest.raises(ValueError):
            cursors.decode(text, bad[0], now=bad[1])
    big = clip({"nodes": [{"id": str(i)} for i in range(50)], "edges": [{"source": str(i), "target": str(i + 1)} for i in range(49)]}, 1500)
    kept = {n["id"] for n in big["nodes"]}
    assert all(e["target"] in kept for e in big["edges"]) and big["clipped"]
    assert largest_fitting(["aaaa"] * 10, 30) == 3
    assert shared_budget({"a": [1, 2, 3], "b": [4]}, 3) == {"a": [1, 2], "b": [4]}
    assert analysis_mode({"path": "a"}) == "file_context" and analysis_mode({"symbol_id": "s"}, {"symbol_id": "t"}) == "call_path"


def test_graph_limits(spark):
    rows = [(k, f"n{k}", "s", f"t{k}", "p", "q", "CALL", k, "resolved", False, "body") for k in range(9)] + [(20, "x", "t1", "u", "q", "r", "CALL", 1, "resolved", False, "lambda")]
    df = spark.createDataFrame(rows, "fact_order long, name string, source_symbol_id string, target_symbol_id string, source_path string, target_path string, kind string, line int, resolution string, type_only boolean, execution_context string")
    few = symbol_graph(df, "s", max_nodes=3, max_edges=500)
    assert len(few["nodes"]) == 3 and len(few["edges"]) == 2 and few["truncated"]
    deep = symbol_graph(df, "s", depth=3)
    assert deep["execution_context_partial"] and "u" in {n["id"] for n in deep["nodes"]}


def test_digest_and_samples(spark):
    files = spark.createDataFrame([(f"f{k}", str(k)) for k in range(30)], "path string, sha256 string")
    assert coverage.inventory_digest(files).first() == coverage.inventory_digest(files.repartition(7)).first()
    indexed = spark.createDataFrame([(f"f{k}", ["ready", "partial"][k % 2]) for k in range(20)], "path string, status string")
    assert [r["category"] for r in coverage.interleaved_sample(files, indexed, 4).collect()] == ["ready", "limited", "unindexed", "ready"]
