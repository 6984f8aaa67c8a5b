"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

#: The six white-space characters that separate words everywhere in this package.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def held_out(column: str, mod: int, remainder: int) -> F.Column:
    """True where crc32 of the id's decimal text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod == remainder


def row_id(known: str | None = None) -> F.Column:
    """The column ``known`` that numbers the rows, or a number for each row of one scan, which only a written table keeps."""
    return (F.col(known) if known else F.monotonically_increasing_id()).alias("rid")


def numbered(docs: DataFrame, *columns: F.Column | str) -> DataFrame:
    """rid, a number for each row, and ``columns`` of ``docs``, written once.

    What is joined on the number later comes from this table, so it does not matter how often, or split how, the
    table behind ``docs`` is read.
    """
    return materialize(docs.select(row_id(), *columns), "numbered")
