"""Answers of several sections, and reads of several ranges, within one budget of characters; many requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.search import lines

#: Items that a section keeps as long as anything else can be dropped; sections not named here keep one.
MINIMUMS = {"symbols": 1, "candidates": 1, "ownership": 1, "edges": 1, "paths": 1, "chains": 1, "unresolved": 0, "not_traversed": 0, "diagnostics": 0}
#: Sections that give up even those at last.
LAST = ("ownership", "edges", "paths", "chains")
#: Characters between two items, and what a clipped answer needs for saying so.
BETWEEN, SLACK = 2, 96


def fit_sections(items: DataFrame, budget: int, slack: int = SLACK) -> DataFrame:
    """``items`` (request, section, place, chars; places from 1) with kept and status of the request.

    What a request has too much is taken from the section that can give most, from its end, and only what that cannot
    give from the next. Sections come down to their minimum first, then those of ``LAST`` to nothing. Since each section
    gives all it can before the next is asked, running sums over the sections, and over the items from their ends,
    tell all of it without a loop. All sums are windows over one exchange by request; the items meet no table of their
    own sums. Status is ``ready`` (all kept), ``clipped``, or ``exceeded`` where the rest is still too long.
    """
    size = F.col("chars") + BETWEEN
    least = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in MINIMUMS.items() for x in pair)), F.col("section")), F.lit(1))
    layer = F.when(F.col("place") > least, 0).when(F.col("section").isin(*LAST), 1).otherwise(2)
    rows = items.repartition("request").withColumns({"size": size, "layer": layer})
    whole, own = Window.partitionBy("request"), Window.partitionBy("request", "section", "layer")
    after = own.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    told = rows.withColumn("after", F.coalesce(F.sum("size").over(after), F.lit(0))).withColumn("gives", F.sum("size").over(own))
    total, can = F.sum("size").over(whole), F.coalesce(F.sum(F.when(F.col("layer") < 2, F.col("size"))).over(whole), F.lit(0))
    told = told.withColumns({"total": total, "can": can})
    # Items of one section and layer are equal in this order, so the sum up to them holds all their own.
    upto = F.sum("size").over(whole.orderBy("layer", F.desc("gives"), "section").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    excess = F.when(F.col("total") > budget, F.col("total") - budget + slack).otherwise(0)
    told = told.withColumns({"before": upto - F.col("gives"), "excess": excess})
    quota = F.when(F.col("layer") < 2, F.greatest(F.lit(0), F.least("gives", F.col("excess") - F.col("before")))).otherwise(0)
    status = F.when(F.col("excess") == 0, "ready").when(F.col("total") - F.col("can") > budget, "exceeded").otherwise("clipped")
    return told.select(*items.columns, (F.col("after") >= quota).alias("kept"), status.alias("status"))


def clipped_fields(fitted: DataFrame) -> DataFrame:
    """request, section, original, returned of the sections that lost items."""
    counts = fitted.groupBy("request", "section").agg(F.count("*").alias("original"), F.count_if("kept").alias("returned"))
    return counts.where("returned < original")


def read_ranges(files: DataFrame, ranges: DataFrame, max_chars: int) -> DataFrame:
    """request, item, path, line, first_char, text, full: the lines of the ranges of each request while their characters fit.

    ``ranges`` has request, item (order in the request), path, start_line, end_line and char_offset (characters of the
    first line to skip). A request's budget runs on from one range to the next; the line that overflows it is cut and
    is the last. ``full`` tells whether the line is shown to its end. Only files that are asked for are cut into lines.
    """
    asked = files.join(ranges.select("path").distinct(), "path", "left_semi")
    met = lines(asked).join(ranges, "path").where("line between start_line and end_line")
    first = F.when(F.col("line") == F.col("start_line"), F.col("char_offset")).otherwise(0)
    rest = F.substring(F.col("text"), first + 1, F.char_length("text"))
    rows = met.select("request", "item", "path", "line", first.alias("first_char"), rest.alias("text"))
    order = Window.partitionBy("request").orderBy("item", "line").rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(max_chars) - F.coalesce(F.sum(F.char_length("text") + 1).over(order), F.lit(0))
    shown = rows.withColumn("room", room).where("room > 0")
    return shown.select("request", "item", "path", "line", "first_char", F.substring("text", F.lit(1), F.col("room").cast("int")).alias("text"), (F.char_length("text") <= F.col("room")).alias("full"))


def range_cursors(files: DataFrame, ranges: DataFrame, max_chars: int) -> DataFrame:
    """request, item, line, char_offset: the position from which the next page of each request that is not done reads on.

    A line that was cut goes on within itself; otherwise the next line of the range, or the beginning of the next range
    that has lines. ``resumed`` puts the position into the ranges.
    """
    order = Window.partitionBy("request").orderBy("item", "line")
    asked = lines(files.join(ranges.select("path").distinct(), "path", "left_semi")).join(ranges, "path").where("line between start_line and end_line")
    shown = read_ranges(files, ranges, max_chars).select("request", "item", "line", "first_char", F.char_length("text").alias("n"), "full")
    met = asked.select("request", "item", "line", F.when(F.col("line") == F.col("start_line"), F.col("char_offset")).otherwise(0).alias("from")).join(shown, ["request", "item", "line"], "left")
    left = met.where("full is null or not full").withColumn("turn", F.row_number().over(order)).where("turn = 1")
    return left.select("request", "item", "line", F.coalesce(F.col("first_char") + F.col("n"), F.col("from")).cast("int").alias("char_offset"))


def resumed(ranges: DataFrame, cursors: DataFrame) -> DataFrame:
    """``ranges`` of the requests with a cursor, from there on."""
    at = cursors.select("request", F.col("item").alias("_item"), F.col("line").alias("_line"), F.col("char_offset").alias("_char"))
    here = F.col("item") == F.col("_item")
    met = ranges.join(at, "request").where("item >= _item")
    return met.select(
        "request", "item", "path", F.when(here, F.col("_line")).otherwise(F.col("start_line")).alias("start_line"), "end_line", F.when(here, F.col("_char")).otherwise(F.col("char_offset")).alias("char_offset")
    )
