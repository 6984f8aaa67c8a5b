"""Literal text search and exact text pages over files (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import excerpt, physical_lines, split_lines


def lines(files: DataFrame, mirror: bool = False) -> DataFrame:
    """path, line (1-based), text of every line."""
    cut = split_lines(F.col("content")) if mirror else physical_lines(F.col("content"))
    return files.select("path", F.posexplode(cut).alias("pos", "text")).select("path", (F.col("pos") + 1).cast("long").alias("line"), "text")


def line_stats(files: DataFrame) -> DataFrame:
    cut = physical_lines(F.col("content"))
    return files.select(
        "path",
        F.size(cut).cast("long").alias("lines"),
        F.coalesce(F.array_max(F.transform(cut, F.char_length)), F.lit(0)).cast("long").alias("longest"),
        F.octet_length("content").cast("long").alias("size"),
    )


def text_search(files: DataFrame, query: str, prefix: str | None = None, chars: int = 1000, mirror: bool = False) -> DataFrame:
    """path, line, column, text, text_start_column, truncated: the first match of each line, case-sensitive.

    Files without the query are dropped before they are split into lines.
    """
    if not query or "\n" in query:
        raise ValueError("the query must be one line of text")
    held = files.where(F.contains("content", F.lit(query)))
    if prefix is not None:
        held = held.where(F.startswith("path", F.lit(prefix)))
    found = lines(held, mirror).where(F.contains("text", F.lit(query)))
    got = excerpt(F.col("text"), query, chars)
    return found.select("path", "line", *(c.alias(k) for k, c in got.items()))


def search_page(found: DataFrame, limit: int, after: tuple[str, int] | None = None) -> DataFrame:
    """The next ``limit`` + 1 matches in order of path and line; one too many tells that there are more."""
    if after is not None:
        path, line = after
        found = found.where((F.col("path") > path) | ((F.col("path") == path) & (F.col("line") > line)))
    return found.orderBy("path", "line").limit(limit + 1)


def with_context(files: DataFrame, query: str, around: int = 1, prefix: str | None = None) -> DataFrame:
    """path, line, context: the lines around each match, joined by LF."""
    if not 0 <= around <= 3:
        raise ValueError("between 0 and 3 lines of context")
    held = files.where(F.contains("content", F.lit(query)))
    if prefix is not None:
        held = held.where(F.startswith("path", F.lit(prefix)))
    cut = held.select("path", physical_lines(F.col("content")).alias("cut"))
    each = cut.select("path", "cut", F.posexplode("cut").alias("pos", "text")).where(F.contains("text", F.lit(query)))
    begin = F.greatest(F.lit(0), F.col("pos") - around)
    part = F.slice("cut", begin + 1, F.col("pos") - begin + 1 + around)
    return each.select("path", (F.col("pos") + 1).cast("long").alias("line"), F.array_join(part, "\n").alias("context"))


def source_page(files: DataFrame, start_line: int, end_line: int, max_chars: int, char_offset: int = 0) -> DataFrame:
    """path, line, text: lines of the range while their characters fit; the line that overflows is cut.

    ``char_offset`` skips characters of the first line, where an earlier page ended.
    """
    row = lines(files).where((F.col("line") >= start_line) & (F.col("line") <= end_line))
    text = F.when(F.col("line") == start_line, F.substring(F.col("text"), F.lit(char_offset + 1), F.char_length("text"))).otherwise(F.col("text"))
    size = F.char_length("text") + 1
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    cut = row.withColumn("text", text).withColumn("room", F.lit(max_chars) - F.coalesce(F.sum(size).over(order), F.lit(0)))
    return cut.where("room > 0").select("path", "line", F.substring(F.col("text"), F.lit(1), F.col("room").cast("int")).alias("text"))


def continuation(files: DataFrame, start_line: int, end_line: int, max_chars: int) -> DataFrame:
    """path, next_line, next_char: where the following page begins, for files whose range is not shown whole."""
    shown = source_page(files, start_line, end_line, max_chars)
    ends = shown.groupBy("path").agg(F.max_by(F.struct("line", F.char_length("text").alias("n")), "line").alias("last"))
    whole = lines(files).where((F.col("line") >= start_line) & (F.col("line") <= end_line)).select("path", "line", F.char_length("text").alias("full"))
    last = ends.select("path", "last.line", "last.n").join(whole, ["path", "line"])
    final = whole.groupBy("path").agg(F.max("line").alias("final"))
    at = last.join(final, "path")
    cut = F.col("n") < F.col("full")
    return at.where(cut | (F.col("line") < F.col("final"))).select(
        "path", F.when(cut, F.col("line")).otherwise(F.col("line") + 1).alias("next_line"), F.when(cut, F.col("n")).otherwise(F.lit(0)).cast("long").alias("next_char")
    )
