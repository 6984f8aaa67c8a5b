"""Reading source trees: listing, admission, budgets, ignore rules, refresh, and project discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import policy
from tessera.functions.text import parent_dirs


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, content, size, sha256, problem for every file below ``root``; problem is null for admitted ones."""
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.element_at(F.split("path", F.lit("\\Q" + base + "\\E"), 2), -1)
    files = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("content").alias("bytes"))
    return admit(files.where(policy.valid_path(F.col("path")) & ~policy.excluded_path(F.col("path"))))


def admit(files: DataFrame) -> DataFrame:
    """Decode (path, size, bytes) and name what keeps a file out."""
    small = F.col("size") <= policy.MAX_FILE_BYTES
    text = F.when(small & F.is_valid_utf8("bytes"), F.col("bytes").cast("string"))
    rows = files.withColumn("content", text)
    problem = (
        F.when(~small, F.lit(f"file exceeds {policy.MAX_FILE_BYTES} bytes"))
        .when(F.col("content").isNull(), F.lit("invalid UTF-8 text"))
        .otherwise(policy.content_problem(F.col("content")))
    )
    return rows.select("path", "content", "size", F.sha2("bytes", 256).alias("sha256"), problem.alias("problem"))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, size, modified of every file; contents are not read."""
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(F.element_at(F.split("path", F.lit("\\Q" + base + "\\E"), 2), -1).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def unchanged_hashes(now: DataFrame, before: DataFrame) -> DataFrame:
    """``now`` (path, size, modified) with the known sha256 where size and time are as before, else null."""
    known = before.select("path", "size", "modified", "sha256")
    return now.join(known, ["path", "size", "modified"], "left")


def check_budget(files: DataFrame, max_files: int = policy.MAX_FILES, max_bytes: int = policy.MAX_TOTAL_BYTES) -> None:
    """Raise if the scan has too many files or bytes: a scan is taken whole or not at all."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n > max_files:
        raise ValueError(f"{n} files exceed the limit of {max_files}")
    if size > max_bytes:
        raise ValueError(f"{size} bytes exceed the limit of {max_bytes}")


def refresh(previous: DataFrame, changed: DataFrame) -> DataFrame:
    """The scan after a change: rows of ``changed`` replace those of equal path; a null content deletes."""
    kept = previous.join(changed.select("path"), "path", "left_anti")
    return kept.unionByName(changed.where("content is not null").select(*previous.columns))


def ignore_rules(text: str) -> list[tuple[str, bool, bool]]:
    """(regular expression, negated, folders only) of each line of an ignore file, in order."""
    rules = []
    for raw in text.split("\n"):
        line = raw.rstrip("\r")
        if not line.strip() or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line.removeprefix("\\")
        line = line.rstrip() if not line.endswith("\\ ") else line
        folder, anchored = line.endswith("/"), "/" in line.rstrip("/")
        body, i, out = line.strip("/"), 0, ""
        while i < len(body):
            if body.startswith("**/", i):
                out, i = out + "(?:[^/]+/)*", i + 3
            elif body.startswith("/**", i) and i + 3 == len(body):
                out, i = out + "/.+", i + 3
            elif body[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif body[i] == "?":
                out, i = out + "[^/]", i + 1
            elif body[i] == "[" and "]" in body[i + 2 :]:
                end = body.index("]", i + 2)
                inner = body[i + 1 : end].replace("\\", "\\\\")
                out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
            else:
                out, i = out + "\\Q" + body[i] + "\\E", i + 1
        rules.append((("^" if anchored else "^(?:.*/)?") + out + "$", negated, folder))
    return rules


def ignored(path: Column, rules: list[tuple[str, bool, bool]]) -> Column:
    """Last match wins; a file below an ignored folder cannot be included again."""

    def verdict(at: Column, is_folder: bool) -> Column:
        out = F.lit(False)
        for pattern, negated, folder in rules:
            if folder and not is_folder:
                continue
            out = F.when(at.rlike(pattern), F.lit(not negated)).otherwise(out)
        return out

    folders = F.filter(parent_dirs(path), lambda p: p != ".")
    return F.exists(folders, lambda p: verdict(p, True)) | verdict(path, False)


# Files and folders that mark the root of a project.
MARKERS = (".git", "pyproject.toml", "pom.xml", "settings.gradle", "settings.gradle.kts", "build.gradle", "build.gradle.kts")


def discover_projects(paths: DataFrame, max_depth: int = 5) -> DataFrame:
    """root, markers of each project among ``paths`` (path): a marked folder below another project's root is one
    of its own only if it holds a repository."""
    at = paths.select(F.explode(F.array(F.col("path"), F.regexp_extract("path", r"^(.*?(?:^|/)\.git)/", 1))).alias("path")).where("path <> ''")
    marked = at.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.col("name").isin(*MARKERS))
    roots = marked.select(F.element_at(parent_dirs(F.col("path")), 1).alias("root"), "name").groupBy("root").agg(F.array_sort(F.collect_set("name")).alias("markers"))
    roots = roots.where(F.when(F.col("root") == ".", 0).otherwise(F.size(F.split("root", "/"))) <= max_depth)
    above = roots.select("root", F.explode(F.when(F.col("root") != ".", parent_dirs(F.col("root"))).otherwise(F.array().cast("array<string>"))).alias("up"))
    nested = above.join(roots.select(F.col("root").alias("up")), "up").select("root").distinct().withColumn("inner", F.lit(True))
    return roots.join(nested, "root", "left").where(F.col("inner").isNull() | F.array_contains("markers", ".git")).drop("inner")


def resolve_names(projects: DataFrame, name: str) -> DataFrame:
    """Projects whose display name, qualified name or alias is ``name``, else those that contain it in any case."""
    names = projects.withColumn("name", F.explode(F.concat(F.array("display_name", "qualified_name"), F.coalesce("aliases", F.array().cast("array<string>")))))
    exact = names.where(F.col("name") == name).select("project_id").distinct().withColumn("match", F.lit("exact"))
    part = names.where(F.contains(F.lower("name"), F.lit(name.lower()))).select("project_id").distinct().withColumn("match", F.lit("candidate"))
    return part.join(exact.select("project_id"), "project_id", "left_anti").where(~F.lit(not exact.isEmpty())).unionByName(exact)
