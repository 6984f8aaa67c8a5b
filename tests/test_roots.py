"""Source roots by configuration and by evidence, and imports below them."""

from tessera.extract import roots
from tessera.extract.python_facts import extract
from tessera.plans.api import Project

SOURCES = {
    "services/api/app/__init__.py": "",
    "services/api/app/util.py": "def helper(v):\n    return v\n",
    "services/api/app/sub/__init__.py": "from ..util import helper\n",
    "services/api/main.py": "from app.util import helper\nfrom app.sub import helper as again\nimport missing\n\ndef run(x):\n    later = lambda: helper(x)\n    missing.go(x)\n    return again(helper(x))\n",
    "other/pkg/__init__.py": "",
    "src/solo.py": "import solo\n",
    "not-a-name/odd.py": "",
}
FILES = "path string, content string, sha256 string, size long, language string"


def project_of(spark, extra=()):
    return Project(spark.createDataFrame([(p, c, str(k), len(c), "python") for k, (p, c) in enumerate([*SOURCES.items(), *extra])], FILES))


def test_evident_roots_and_names(spark):
    facts = extract(spark.createDataFrame(list(SOURCES.items()), "path string, content string"))
    found = roots.evident_roots(facts)
    assert {r["root"] for r in found.collect()} == {"", "src", "services/api"}
    names = {}
    for r in roots.module_names(facts.select("path"), found).collect():
        names.setdefault(r["path"], set()).add(r["module"])
    assert names["services/api/app/util.py"] == {"app.util", "services.api.app.util"} and names["src/solo.py"] == {"solo", "src.solo"}
    assert names["services/api/app/__init__.py"] == {"app", "services.api.app"} and "not-a-name/odd.py" not in names
    few = roots.evident_roots(facts, most=2).collect()
    assert {r["root"] for r in few} == {"", "src"} and {r["diagnostic"] for r in few} == {roots.TOO_MANY}


def test_configured_roots(spark):
    read = lambda text: {(r["root"], r["mode"], r["diagnostic"]) for r in roots.configured_roots(spark.createDataFrame([("pyproject.toml", text), ("sub/pyproject.toml", "x")], "path string, content string")).collect()}
    assert read('[tool.tessera]\npython_source_roots = ["lib", "."]\n') == {("lib", "configured", None), ("", "configured", None)}
    assert read("[tool.other]\nx = 1\n") == read("[project]\n") == set()
    for bad in ("[tool.tessera]\npython_source_roots = 3\n", "[tool.tessera]\npython_source_roots = []\n", "[tool", '[tool.tessera]\npython_source_roots = ["../x"]\n'):
        assert read(bad) == {(None, "invalid", roots.INVALID)}


def test_imports_below_a_projects_own_root_resolve(spark):
    project = project_of(spark)
    got = {(r["source_path"], r["kind"], r["name"]): (r["resolution"], r["target_path"], r["target_qualname"]) for r in project.relations.where("kind in ('IMPORT', 'CALL')").collect()}
    util = ("resolved", "services/api/app/util.py", "helper")
    assert got["services/api/main.py", "IMPORT", "app.util.helper"] == got["services/api/main.py", "CALL", "helper"] == got["services/api/main.py", "CALL", "again"] == util
    assert got["services/api/app/sub/__init__.py", "IMPORT", "..util.helper"] == util and got["src/solo.py", "IMPORT", "solo"][:2] == ("resolved", "src/solo.py")
    run = project.find(qualname="run")
    assert run["status"] == "found" and project.find(path="services/api/main.py", line=7)["symbol_id"] == run["symbol_id"]
    assert project.find(name="helper", kind="class")["status"] == "not_found"
    gaps = {(r["name"], r["reason"]) for r in project.call_gaps(run["symbol_id"]).collect()}
    assert gaps == {("missing.go", "unresolved"), ("helper", "not_traversed")}
