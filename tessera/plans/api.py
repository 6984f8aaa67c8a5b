"""One project's facts behind named queries, as a reader of the code asks for them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import bind
from tessera.extract.python_facts import extract
from tessera.extract.roots import source_roots
from tessera.operators import coverage, dependencies, flow, graph, relations, search
from tessera.plans.render import Cursors, symbol_graph
from tessera.session import materialize


@dataclass
class Project:
    """Files (path, content, sha256, size, language) and what follows from them. Relations and value flow are written once, when first asked for."""

    files: DataFrame
    cursors: Cursors = field(default_factory=Cursors)

    def __post_init__(self) -> None:
        self.facts = extract(self.files)
        self._relations: DataFrame | None = None
        self._flow: DataFrame | None = None

    @property
    def relations(self) -> DataFrame:
        if self._relations is None:
            self._relations = materialize(bind.relations(self.facts, source_roots(self.files, self.facts)), "project-relations")
        return self._relations

    @property
    def symbols(self) -> DataFrame:
        return bind.symbols_of(self.facts)

    def overview(self) -> DataFrame:
        return coverage.histogram(self.files, "language")

    def search_code(self, query: str, limit: int = 50, prefix: str | None = None, cursor: str | None = None) -> dict:
        digest = coverage.inventory_digest(self.files).first()[0]
        after = self.cursors.decode(cursor, query, prefix or "", digest) if cursor else None
        rows = search.search_page(search.text_search(self.files, query, prefix), limit, after).collect()
        more = len(rows) > limit
        rows = [r.asDict() for r in rows[:limit]]
        out = {"matches": rows, "has_more": more}
        if more:
            out["cursor"] = self.cursors.encode((rows[-1]["path"], rows[-1]["line"]), query, prefix or "", digest)
        return out

    def read_file(self, path: str, start_line: int = 1, end_line: int = 200, max_chars: int = 20_000, char_offset: int = 0) -> DataFrame:
        return search.source_page(self.files.where(F.col("path") == path), start_line, end_line, max_chars, char_offset)

    def symbol_search(self, query: str, **how) -> DataFrame:
        return relations.symbol_search(self.symbols, query, **how)

    def read_symbol(self, symbol_id: str, max_chars: int = 20_000) -> DataFrame:
        s = self.symbols.where(F.col("symbol_id") == symbol_id).first()
        if s is None:
            raise KeyError("unknown symbol")
        return self.read_file(s["path"], s["start_line"], s["end_line"], max_chars)

    def find_references(self, symbol_id: str, include_imports: bool = True) -> DataFrame:
        return relations.find_references(self.relations, symbol_id, include_imports)

    def call_graph(self, symbol_id: str, **limits) -> dict:
        return symbol_graph(self.relations, symbol_id, "call", **limits)

    def class_graph(self, symbol_id: str, **limits) -> dict:
        return symbol_graph(self.relations, symbol_id, "class", **limits)

    def _file_pairs(self, include_type_only: bool = True) -> DataFrame:
        return relations.file_pairs(self.relations, include_type_only)

    def file_dependencies(self, path: str, depth: int = 1, direction: str = "outgoing", include_type_only: bool = True) -> DataFrame:
        seed = self.files.where(F.col("path") == path).select(F.col("path").alias("node"))
        return graph.chains(self._file_pairs(include_type_only), seed, depth, direction)

    def impact(self, path: str, depth: int = 3) -> DataFrame:
        return self.file_dependencies(path, depth, "incoming")

    def architecture(self, prefix: str | None = None, include_type_only: bool = False) -> DataFrame:
        pairs = self._file_pairs(include_type_only)
        if prefix:
            pairs = pairs.where(F.startswith("src", F.lit(prefix)) & F.startswith("tgt", F.lit(prefix)))
        known = graph.layers(pairs)
        alone = self.facts.select(F.col("path").alias("node")).join(known.select("node"), "node", "left_anti")
        if prefix:
            alone = alone.where(F.startswith("node", F.lit(prefix)))
        return known.unionByName(alone.select("node", F.col("node").alias("scc"), F.lit(0).alias("layer"), F.lit(False).alias("cyclic")))

    def call_paths(self, source: str, target: str, depth: int = 5) -> DataFrame:
        calls = self.relations.where(relations.traversable_call() & (F.col("resolution") == "resolved"))
        pairs = self.files.sparkSession.createDataFrame([(source, target)], "source string, target string")
        return graph.shortest_paths(calls.select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("tgt")).where("src is not null"), pairs, depth)

    def call_gaps(self, source: str, depth: int = 5) -> DataFrame:
        """Calls that a search for paths from ``source`` met and could not follow, with the reason."""
        seeds = self.files.sparkSession.createDataFrame([(source,)], "node string")
        return relations.call_gaps(self.relations, seeds, depth)

    def find(self, **selector) -> dict:
        """What a selector (symbol_id, path, qualname, name, kind, line, as far as given) names: status and candidates."""
        fields = {k: selector.pop(k, None) for k in relations.SELECTOR_FIELDS}
        if selector or not any(v is not None for v in fields.values()):
            raise ValueError(f"a selector has some of {', '.join(relations.SELECTOR_FIELDS)}")
        asked = self.files.sparkSession.createDataFrame([(0, *fields.values())], relations.SELECTORS)
        return relations.select_symbols(self.symbols, asked).first().asDict(recursive=True)

    def external_dependencies(self) -> DataFrame:
        rows = self.relations.where("kind = 'IMPORT' and resolution in ('external_or_unavailable', 'unavailable')")
        named = rows.select(F.col("source_path").alias("path"), "name", "line", F.lit("python").alias("language"), "target_path", F.coalesce("target_module", "name").alias("module"))
        kinds = dependencies.classify(named, dependencies.declarations(self.files), bind.modules_of(self.facts))
        return dependencies.dependency_groups(kinds)

    def value_flow(self) -> DataFrame:
        if self._flow is None:
            self._flow = materialize(flow.flow_edges(self.facts, self.relations), "project-flow")
        return self._flow

    def index_coverage(self) -> DataFrame:
        return coverage.coverage(self.files, self.facts)
