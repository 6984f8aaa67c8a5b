"""Line differences and edits of texts."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LINES, MAX_PRODUCT = 10_000, 4_000_000


def changed_texts(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, old, new of files (path, sha256, content) that differ; equal hashes never carry their texts on."""
    a = before.select("path", F.col("sha256").alias("a"), F.col("content").alias("old"))
    b = after.select("path", F.col("sha256").alias("b"), F.col("content").alias("new"))
    return a.join(b, "path", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("path", "old", "new")


def _counts(old: str | None, new: str | None) -> tuple[int, int]:
    a, b = (old or "").splitlines(), (new or "").splitlines()
    gone = added = 0
    for tag, i, j, k, m in difflib.SequenceMatcher(a=a, b=b).get_opcodes():
        if tag != "equal":
            gone, added = gone + j - i, added + m - k
    return added, gone


def line_counts(changes: DataFrame) -> DataFrame:
    """path, insertions, deletions of changed texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = [_counts(a, b) for a, b in zip(df["old"], df["new"], strict=True)]
            yield pd.DataFrame({"path": df["path"], "insertions": [x[0] for x in found], "deletions": [x[1] for x in found]})

    return changes.select("path", "old", "new").mapInPandas(run, "path string, insertions long, deletions long")


def bounded_patch(path: str, old: str | None, new: str | None, most: int) -> tuple[str, bool]:
    """A unified patch of whole lines within ``most`` characters, and whether it is complete."""
    a, b = (old or "").splitlines(keepends=True), (new or "").splitlines(keepends=True)
    if max(len(a), len(b)) > MAX_LINES or len(a) * len(b) > MAX_PRODUCT:
        return "", False
    out, size = [], 0
    for line in difflib.unified_diff(a, b, "/dev/null" if old is None else f"a/{path}", "/dev/null" if new is None else f"b/{path}"):
        line = line if line.endswith("\n") else line + "\n\\ No newline at end of file\n"
        if size + len(line) > most:
            return "".join(out), False
        out.append(line)
        size += len(line)
    return "".join(out), True


def patches(changes: DataFrame, most: int = 20_000) -> DataFrame:
    """path, patch, complete of changed texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = [bounded_patch(p, a, b, most) for p, a, b in zip(df["path"], df["old"], df["new"], strict=True)]
            yield pd.DataFrame({"path": df["path"], "patch": [x[0] for x in found], "complete": [x[1] for x in found]})

    return changes.select("path", "old", "new").mapInPandas(run, "path string, patch string, complete boolean")


def _occurrences(text: str, part: str) -> int:
    n, at = 0, text.find(part)
    while at >= 0:
        n, at = n + 1, text.find(part, at + 1)
    return n


def apply_edit(text: str, kind: str, start: int | None = None, end: int | None = None, old: str | None = None, new: str = "") -> str:
    """The text after one edit; a fragment must occur exactly once, overlaps counted."""
    if kind == "replace_fragment":
        if not old or _occurrences(text, old) != 1:
            raise ValueError("the fragment must occur exactly once")
        return text.replace(old, new, 1)
    rows = text.splitlines(keepends=True)
    if kind == "insert_lines":
        if start is None or not 1 <= start <= len(rows) + 1:
            raise ValueError("no such line")
        end = start - 1
    elif kind == "replace_lines":
        if start is None or end is None or not 1 <= start <= end <= len(rows):
            raise ValueError("no such lines")
    else:
        raise ValueError("unknown edit")
    piece = new if not new or new.endswith("\n") or end == len(rows) else new + "\n"
    head = "".join(rows[: start - 1])
    if head and not head.endswith("\n"):
        head += "\n"
    return head + piece + "".join(rows[end:])


def edited(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, content, problem: each file of ``edits`` (path, kind, start, end, old, new) after its edit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for r in df.astype(object).where(df.notna(), None).itertuples(index=False):
                try:
                    out.append((r.path, apply_edit(r.content, r.kind, r.start and int(r.start), r.end and int(r.end), r.old, r.new or ""), None))
                except ValueError as error:
                    out.append((r.path, r.content, str(error)))
            yield pd.DataFrame(out, columns=["path", "content", "problem"])

    return files.select("path", "content").join(edits, "path").mapInPandas(run, "path string, content string, problem string")
