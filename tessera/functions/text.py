"""Column functions on text: physical lines, literal matches, ASCII-folded search, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters shown before a match, and in all.
BEFORE, EXCERPT = 200, 1000


def physical_lines(content: Column) -> Column:
    """Lines split at LF or CRLF; the end of the last line opens no further one, a bare CR stays."""
    lines = F.split(content, "\n", -1)
    closed = F.when(content.endswith("\n") | (content == ""), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    return F.transform(closed, lambda line: F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.char_length(line) - 1)).otherwise(line))


def split_lines(content: Column) -> Column:
    """Lines split at every line boundary Unicode knows, as a mirror search sees them."""
    lines = F.split(content, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def ascii_lower(text: Column) -> Column:
    """A-Z folded, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def contains_folded(text: Column, query: str) -> Column:
    """Substring test that ignores ASCII case only; the query has no wildcards."""
    return ascii_lower(text).contains(query.translate(str.maketrans(_UPPER, _LOWER)))


def excerpt(line: Column, query: str, chars: int = EXCERPT) -> dict[str, Column]:
    """The first match in a line: column (1-based), the text around it, where that begins, whether it is cut."""
    at = F.instr(line, query)
    before = min(BEFORE, max(0, chars - len(query)) // 2)
    begin = F.greatest(F.lit(0), at - 1 - before)
    return {
        "column": at.cast("long"),
        "text": F.substring(line, begin + 1, F.lit(chars)),
        "text_start_column": (begin + 1).cast("long"),
        "truncated": (begin > 0) | (begin + chars < F.char_length(line)),
    }


def symbol_id(path: Column, qualname: Column, line: Column) -> Column:
    """A stable identifier of a definition."""
    key = F.concat(path, F.lit("\0"), qualname, F.lit("\0"), line.cast("string"))
    return F.concat(F.lit("sym_"), F.substring(F.sha2(key, 256), 1, 32))


def parent_dirs(path: Column) -> Column:
    """All directories above a path, nearest first; the root is '.'."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.when(n == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/"))
    )



def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
