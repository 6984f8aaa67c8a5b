"""Symbols, references and relation edges: filters, pages, aggregated file edges, frontier expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import contains_folded
from tessera.operators import graph
from tessera.schemas import CALLABLE_KINDS, CLASS_KINDS

CALL_KINDS = ("CALL", "INSTANTIATION")
CLASS_GRAPH_KINDS = ("INHERITANCE", "IMPLEMENTS", "CONTAINS", "TYPE_REFERENCE", "INSTANTIATION")


def symbol_search(symbols: DataFrame, query: str, exact: bool = False, kind: str | None = None, language: str | None = None, prefix: str | None = None) -> DataFrame:
    """Symbols by name: equal, or containing the query with ASCII case ignored. Modules only if asked for."""
    rows = symbols.where(F.col("name") == query) if exact else symbols.where(contains_folded(F.col("name"), query))
    rows = rows.where(F.col("kind") == kind) if kind else rows.where("kind <> 'module'")
    if language:
        rows = rows.where(F.col("language") == language)
    return rows.where(F.startswith("path", F.lit(prefix))) if prefix else rows


def by_ids(rows: DataFrame, ids: DataFrame, column: str = "symbol_id") -> DataFrame:
    return rows.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")


def by_signature_stem(symbols: DataFrame, path: str, qualname: str) -> DataFrame:
    """Symbols of that qualified name, else those whose name without parameters is the given one."""
    here = symbols.where(F.col("path") == path)
    exact = here.where(F.col("qualname") == qualname)
    stem = here.where(F.substring_index("qualname", "(", 1) == qualname)
    any_exact = exact.select(F.lit(1).alias("_any")).limit(1)
    return exact.unionByName(stem.join(F.broadcast(any_exact), F.lit(True), "left_anti"))


def resolve_selectors(symbols: DataFrame, selectors: DataFrame, shown: int = 10) -> DataFrame:
    """qualname, status, candidates, symbol_id and the first candidates of each selector (qualname).

    A selector with one definition is found; with several it is ambiguous and names candidates, never one of them.
    """
    asked = selectors.select("qualname").distinct()
    met = asked.join(symbols.select("qualname", "symbol_id", "path"), "qualname", "left")
    place = F.row_number().over(Window.partitionBy("qualname").orderBy("path", "symbol_id"))
    n = F.count("symbol_id")
    found = met.groupBy("qualname").agg(n.alias("candidates"), F.when(n == 1, F.min("symbol_id")).alias("symbol_id"))
    first = met.withColumn("place", place).where(F.col("place") <= shown).groupBy("qualname")
    listed = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol_id"))), lambda x: x["symbol_id"]), ",").alias("first"))
    status = F.when(F.col("candidates") == 0, "not_found").when(F.col("candidates") == 1, "found").otherwise("ambiguous")
    return found.join(listed, "qualname").select("qualname", status.alias("status"), "candidates", "symbol_id", "first")


SELECTOR_FIELDS = ("symbol_id", "path", "qualname", "name", "kind", "line")
SELECTORS = "ask long, symbol_id string, path string, qualname string, name string, kind string, line int"


def select_symbols(symbols: DataFrame, selectors: DataFrame, shown: int = 10) -> DataFrame:
    """ask, status, candidates, symbol_id and the first candidates of each of ``SELECTORS``; what is null is not asked for.

    A line lies within a symbol, and where a selector gives one, the innermost symbols around it are meant. Selectors
    are dealt by the sharpest things they name, so each meets the symbols in one equal join: by id, by path and qualified
    name, by path and name, by path, by qualified name or by name. One without any of these has status ``invalid``.

    Selectors that ask the same are answered once, and symbols that no selector of a join can tell apart meet it as one row
    with
    their number and the first of them. A name that many symbols have and many selectors ask for costs its symbols plus
    its selectors; only distinct lines asked for meet the distinct ranges of lines of its symbols.
    """
    fields = ("symbol_id", "path", "qualname", "name")
    given = lambda f: F.col(f).isNotNull()
    by = (
        F.when(given("symbol_id"), "symbol_id").when(given("path") & given("qualname"), "path qualname").when(given("path") & given("name"), "path name")
        .when(given("path"), "path").when(given("qualname"), "qualname").when(given("name"), "name")
    )
    wants = [F.col(f).alias(f"want_{f}") for f in SELECTOR_FIELDS]
    asked = selectors.where(by.isNotNull()).select(*wants, by.alias("by")).distinct()
    # What a join's keys leave open: further fields that its selectors may name.
    further = {"symbol_id": ("path", "qualname", "name"), "path qualname": ("name",), "path name": (), "path": (), "qualname": ("name",), "name": ()}
    same = ["want_" + f for f in SELECTOR_FIELDS]
    met = None
    for keys, more in further.items():
        on = keys.split(" ")
        alike = [*on, *more, "kind", "lined", "from", "to"]
        place = F.row_number().over(Window.partitionBy(*(f"_{c}" for c in alike)).orderBy("path", "start_line", "symbol_id"))
        own = symbols.select(*fields, "kind", "start_line", "end_line", F.explode(F.array(F.lit(True), F.lit(False))).alias("lined"))
        own = own.withColumns({"from": F.when(F.col("lined"), F.col("start_line")), "to": F.when(F.col("lined"), F.col("end_line"))})
        ranked = own.select("path", "start_line", "symbol_id", *(F.col(c).alias(f"_{c}") for c in alike)).withColumn("place", place).where(F.col("place") <= shown)
        first = ranked.groupBy(*(f"_{c}" for c in alike)).agg(F.array_sort(F.collect_list(F.struct("path", "start_line", "symbol_id"))).alias("first"))
        n = own.groupBy(*alike).agg(F.count("*").alias("n"))
        groups = n.join(first, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in alike]).select(*alike, "n", "first")
        fits = F.col("want_kind").isNull() | (F.col("want_kind") == F.col("kind"))
        for f in more:
            fits &= F.col(f"want_{f}").isNull() | (F.col(f"want_{f}") == F.col(f))
        fits &= F.col("want_line").isNull() | F.col("want_line").between(F.col("from"), F.col("to"))
        equal = F.col("want_line").isNotNull() == F.col("lined")
        for f in on:
            equal &= F.col(f"want_{f}") == F.col(f)
        span = F.when(F.col("lined"), F.col("to") - F.col("from")).otherwise(0)
        part = asked.where(F.col("by") == keys).join(groups, equal).where(fits).select(*same, "by", span.alias("span"), "n", "first")
        met = part if met is None else met.unionByName(part)
    inner = met.withColumn("least", F.min("span").over(Window.partitionBy(*same))).where("span = least")
    told = inner.groupBy(*same).agg(F.sum("n").alias("candidates"), F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, shown).alias("f"))
    told = selectors.select("ask", *wants, by.alias("by")).join(
        told.withColumnsRenamed({c: f"_{c}" for c in same}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same], "left"
    )
    told = told.withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("long")))
    n = F.col("candidates")
    status = F.when(F.col("by").isNull(), "invalid").when(n == 0, "not_found").when(n == 1, "found").otherwise("ambiguous")
    return told.select("ask", status.alias("status"), "candidates", F.when(n == 1, F.col("f")[0]["symbol_id"]).alias("symbol_id"), F.transform(F.coalesce("f", F.array()), lambda x: x["symbol_id"]).alias("first"))


def call_gaps(relations: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """seed, source_symbol_id, line, name, distance, reason of the calls that a walk from each seed (node) met and could not
    follow: ``unresolved`` (ambiguous and external ones too), or ``not_traversed``, since they run elsewhere or never."""
    follow = traversable_call() & (F.col("resolution") == "resolved") & F.col("source_symbol_id").isNotNull() & F.col("target_symbol_id").isNotNull()
    steps = relations.where(follow).select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("tgt"))
    reach = graph.distances(steps, seeds, depth).where(F.col("distance") < depth)
    calls = relations.where(F.col("kind").isin(*CALL_KINDS) & F.col("source_symbol_id").isNotNull() & ~F.coalesce(follow, F.lit(False)))
    reason = F.when((F.col("resolution") != "resolved") | F.col("target_symbol_id").isNull(), "unresolved").otherwise("not_traversed")
    met = reach.join(calls.withColumn("reason", reason), F.col("node") == F.col("source_symbol_id"))
    return met.select("seed", "source_symbol_id", "line", "name", "distance", "reason")


def file_context(edges: DataFrame, seeds: DataFrame, shown: int = 5) -> DataFrame:
    """path, section, place, other, evidence_count, total: the first neighbours of each seed file (path) by section.

    Sections are ``depends_on`` and ``used_by``; total is the number of neighbours of which the section shows a part.
    """
    out = edges.select(F.col("source").alias("path"), F.lit("depends_on").alias("section"), F.col("target").alias("other"), "evidence_count")
    back = edges.select(F.col("target").alias("path"), F.lit("used_by").alias("section"), F.col("source").alias("other"), "evidence_count")
    both = out.unionByName(back).join(seeds.select("path").distinct(), "path", "left_semi").where("path <> other")
    own = Window.partitionBy("path", "section")
    ranked = both.withColumn("place", F.row_number().over(own.orderBy("other"))).withColumn("total", F.count("*").over(own))
    return ranked.where(F.col("place") <= shown)


def find_references(relations: DataFrame, target: str | None = None, include_imports: bool = True) -> DataFrame:
    rows = relations.where("kind <> 'CONTAINS' and target_symbol_id is not null")
    if target is not None:
        rows = rows.where(F.col("target_symbol_id") == target)
    return rows if include_imports else rows.where("kind <> 'IMPORT'")


def traversable_call() -> Column:
    """A call that runs where it stands: not deferred into a body of its own, not for types only."""
    context = F.coalesce("execution_context", F.lit("body"))
    return F.col("kind").isin(*CALL_KINDS) & context.isin("body", "definition", "immediate_lambda") & ~F.coalesce("type_only", F.lit(False))


def file_edge() -> Column:
    return (
        (F.col("resolution") == "resolved") & F.col("target_path").isNotNull() & (F.col("kind") != "CONTAINS")
        & ((F.col("source_path") != F.col("target_path")) | (F.col("kind") == "IMPORT"))
    )


def file_pairs(relations: DataFrame, include_type_only: bool = True) -> DataFrame:
    """Distinct (src, tgt) of the edges between files, without their evidence."""
    rows = relations.where(file_edge())
    if not include_type_only:
        rows = rows.where(~F.coalesce("type_only", F.lit(False)))
    return rows.select(F.col("source_path").alias("src"), F.col("target_path").alias("tgt")).distinct()


def file_edges(relations: DataFrame, evidence: int = 5) -> DataFrame:
    """source, target, kinds, evidence (the first few, by line and order), evidence_count, type_only.

    Evidence is ranked before it is collected, so a pair with many relations collects only a few.
    """
    rows = relations.where(file_edge())
    place = F.row_number().over(Window.partitionBy("source_path", "target_path").orderBy("line", "fact_order"))
    sums = rows.groupBy("source_path", "target_path").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("*").alias("evidence_count"), F.bool_and("type_only").alias("type_only")
    )
    item = F.struct(F.col("place"), "kind", "line", "name", F.col("evidence").alias("basis"))
    first = rows.withColumn("place", place).where(F.col("place") <= evidence).groupBy("source_path", "target_path").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    return sums.join(first, ["source_path", "target_path"]).withColumnsRenamed({"source_path": "source", "target_path": "target"})


def frontier_edges(relations: DataFrame, frontier: DataFrame, kinds: tuple[str, ...], top: int, direction: str = "both") -> DataFrame:
    """The first ``top`` edges of each frontier node (node), in order of source_path, line, kind, fact_order.

    A self-edge counts once. Both sides are ranked together; Spark keeps only the first ranks before the shuffle.
    """
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError("unknown direction")
    rows = relations.where(F.col("kind").isin(*kinds))
    parts = []
    if direction in ("outgoing", "both"):
        parts.append(rows.join(frontier, rows["source_symbol_id"] == frontier["node"]).withColumn("side", F.lit("out")))
    if direction in ("incoming", "both"):
        met = rows.join(frontier, rows["target_symbol_id"] == frontier["node"])
        if direction == "both":
            met = met.where(~F.col("source_symbol_id").eqNullSafe(F.col("target_symbol_id")))
        parts.append(met.withColumn("side", F.lit("in")))
    place = F.row_number().over(Window.partitionBy("node").orderBy("source_path", "line", "kind", "fact_order"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.withColumn("place", place).where(F.col("place") <= top)


def hydrate(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with the names of both ends; an end without a symbol stays null."""
    named = symbols.select("symbol_id", "qualname", "path")
    a = named.select(F.col("symbol_id").alias("source_symbol_id"), F.col("qualname").alias("source_name"))
    b = named.select(F.col("symbol_id").alias("target_symbol_id"), F.col("qualname").alias("target_name"))
    return edges.join(a, "source_symbol_id", "left").join(b, "target_symbol_id", "left")


def ownership(relations: DataFrame) -> DataFrame:
    """(src, tgt) of CONTAINS relations between symbols."""
    rows = relations.where("kind = 'CONTAINS' and source_symbol_id is not null and target_symbol_id is not null")
    return rows.select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("tgt"))


def is_callable(kind: Column) -> Column:
    return kind.isin(*CALLABLE_KINDS)


def is_class(kind: Column) -> Column:
    return kind.isin(*CLASS_KINDS)
