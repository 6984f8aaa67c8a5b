"""Source roots: the folders below which a project's modules are named.

Roots are configured, or follow from evidence: the top of the tree, ``src`` where it is no package itself, and the
folder above a package that is not inside another and that some file imports by its name. A file has a name below
every root that holds it; the deepest root's is its own, and relative imports start from there.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.extract.python_facts import table
from tessera.functions import policy
from tessera.functions.text import parent_dirs

MAX_ROOTS, MAX_CONFIG_BYTES = 32, 64 * 1024
INVALID, TOO_MANY = "SOURCE_ROOTS_INVALID", "SOURCE_ROOT_LIMIT_EXCEEDED"
ROOTS = "root string, mode string, diagnostic string"


def read_configuration(content: str | None, tool: str) -> list[str] | None:
    """The roots that a pyproject.toml names under ``tool``; None where it names none. Anything else is a ValueError."""
    if content is None:
        return None
    if len(content.encode()) > MAX_CONFIG_BYTES:
        raise ValueError("too large")
    own = tomllib.loads(content).get("tool", {})
    if not isinstance(own, dict) or tool not in own:
        return None
    if not isinstance(own[tool], dict):
        raise ValueError("not a table")
    roots = own[tool].get("python_source_roots")
    if roots is None:
        return None
    if not isinstance(roots, list) or not 1 <= len(roots) <= MAX_ROOTS or not all(isinstance(r, str) for r in roots):
        raise ValueError("not a list of roots")
    return sorted({"" if r == "." else r for r in roots})


def configured_roots(files: DataFrame, tool: str = "tessera") -> DataFrame:
    """``ROOTS`` of the pyproject.toml at the top of ``files`` (path, content); no row where nothing is configured.

    A configuration that is invalid gives one row without a root, which tells so; such a project has no modules.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for content in df["content"]:
                try:
                    out += [(r, "configured", None) for r in read_configuration(content, tool) or []]
                except (ValueError, RecursionError):
                    out.append((None, "invalid", INVALID))
            yield pd.DataFrame(out, columns=["root", "mode", "diagnostic"])

    found = files.where("path = 'pyproject.toml'").select("content").mapInPandas(run, ROOTS)
    sound = (F.col("root") == "") | policy.valid_path(F.col("root")) | F.col("root").isNull()
    return found.select(F.when(sound, F.col("root")).alias("root"), F.when(sound, F.col("mode")).otherwise("invalid").alias("mode"), F.when(sound, F.col("diagnostic")).otherwise(INVALID).alias("diagnostic")).distinct()


def evident_roots(facts: DataFrame, most: int = MAX_ROOTS) -> DataFrame:
    """``ROOTS`` by evidence. With more than ``most`` of them only the top and src stand, and the rows tell so."""
    here = parent_dirs(F.col("path"))[0]
    packages = facts.where(r"path rlike '/__init__\\.pyi?$'").select(here.alias("package")).distinct()
    above = F.when(F.contains("package", F.lit("/")), F.regexp_replace("package", "/[^/]*$", "")).otherwise("")
    tops = packages.withColumn("root", above).join(packages.select(F.col("package").alias("root")), "root", "left_anti")
    imported = table(facts, "imports").where("level = 0 and module <> ''").select(F.split("module", r"\.")[0].alias("name")).distinct()
    custom = tops.withColumn("name", F.element_at(F.split("package", "/"), -1)).join(imported, "name", "left_semi").select("root").distinct()
    src = facts.where("startswith(path, 'src/')").select(F.lit("src").alias("root")).distinct().join(packages.select(F.col("package").alias("root")), "root", "left_anti")
    plain = facts.sparkSession.createDataFrame([("",)], "root string").unionByName(src)
    every = plain.unionByName(custom).distinct()
    # At most ``most`` + 1 rows are looked at.
    if len(every.limit(most + 1).take(most + 1)) > most:
        return plain.select("root", F.lit("auto").alias("mode"), F.lit(TOO_MANY).alias("diagnostic"))
    return every.select("root", F.lit("auto").alias("mode"), F.lit(None).cast("string").alias("diagnostic"))


def source_roots(files: DataFrame, facts: DataFrame, tool: str = "tessera") -> DataFrame:
    """``ROOTS`` of a project: those configured, else those evident."""
    known = configured_roots(files, tool)
    return evident_roots(facts) if known.isEmpty() else known


def module_names(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path, module, depth: a name for every root that holds the path and leaves only identifiers; depth is the root's."""
    up = paths.select("path", F.explode(F.transform(parent_dirs(F.col("path")), lambda d: F.when(d == ".", "").otherwise(d))).alias("root"))
    met = up.join(F.broadcast(roots.where("root is not null").select("root").distinct()), "root")
    stem = F.regexp_replace(F.expr("case when root = '' then path else substring(path, length(root) + 2) end"), r"\.pyi?$", "")
    parts: Column = F.split(F.regexp_replace(stem, "(^|/)__init__$", ""), "/")
    named = met.select("path", "root", parts.alias("parts")).where(F.forall("parts", lambda p: p.rlike("^[A-Za-z_][A-Za-z0-9_]*$")))
    depth = F.when(F.col("root") == "", 0).otherwise(F.size(F.split("root", "/")))
    return named.select("path", F.array_join("parts", ".").alias("module"), depth.alias("depth")).distinct()
