"""The library's own queries over the test tables, each with its SQL where SQL can express it.

Results have flat columns; lists are joined to text in a stated order.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import bind
from tessera.extract.python_facts import BINDING_LISTS, extract, table
from tessera.functions import policy
from tessera.functions.catalogues import JAVA_PACKAGES, JAVA_STANDARD, PYTHON_MODULES
from tessera.operators import budget, coverage, dependencies, diff, flow, graph, journal, relations, search, sections, tasks
from tessera.plans import standins as s
from tessera.sources import snapshots
from tessera.session import materialize, maybe_broadcast
from tessera.streaming import cdc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_FILES = """files AS (SELECT source || '/' || doc_id AS path, text AS content, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size,
  lang AS language, source AS project_id, doc_id FROM documents)"""
_BEFORE = """before AS (SELECT path, sha256(c) AS sha256, c AS content FROM (SELECT path, CASE WHEN doc_id % 7 = 0 THEN content || 'x' ELSE content END AS c
  FROM files WHERE doc_id % 10 <> 0))"""
_LINES = """lines AS (SELECT path, unnest(parts) AS raw, unnest(range(1, len(parts) + 1)) AS line, len(parts) AS n FROM
  (SELECT path, string_split(content, chr(10)) AS parts FROM files)),
physical AS (SELECT path, line, CASE WHEN ends_with(raw, chr(13)) THEN raw[:-2] ELSE raw END AS text FROM lines WHERE NOT (line = n AND raw = ''))"""
_RELATIONS = """n AS (SELECT count(*) AS n FROM customer),
relations AS (SELECT o_orderkey AS fact_order, 'n' || o_custkey AS src, 'n' || ((o_orderkey * 7919) % n) AS tgt,
  'n' || CAST(floor(o_custkey / 4) AS BIGINT) AS source_path, 'n' || CAST(floor(((o_orderkey * 7919) % n) / 4) AS BIGINT) AS target_path,
  CASE WHEN o_orderstatus = 'F' THEN 'CALL' ELSE 'IMPORT' END AS kind, o_orderkey AS line, 'r' || o_orderkey AS name, o_orderkey % 5 = 0 AS type_only
  FROM orders, n),
edges AS (SELECT DISTINCT src, tgt FROM relations)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_MATCH = """, m AS (SELECT path, line, text, instr(text, '{q}') AS col FROM physical WHERE contains(text, '{q}'){extra})
SELECT path, line, CAST(col AS BIGINT) AS "column", substr(text, greatest(0, col - 1 - 200) + 1, 1000) AS text,
  CAST(greatest(0, col - 1 - 200) + 1 AS BIGINT) AS text_start_column, greatest(0, col - 1 - 200) > 0 OR greatest(0, col - 1 - 200) + 1000 < length(text) AS truncated FROM m"""


@query(f"WITH {_FILES}, {_LINES}" + _MATCH.format(q="tion", extra=""))
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.text_search(s.files(spark, sf_dir), "tion")


@query(f"WITH {_FILES}, {_LINES}" + _MATCH.format(q="the", extra=" AND starts_with(path, 'src1/')"))
def text_search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.text_search(s.files(spark, sf_dir), "the", prefix="src1/")


@query(f"""WITH {_FILES}, {_LINES}
SELECT a.path, a.line, string_agg(b.text, chr(10) ORDER BY b.line) AS context FROM physical a JOIN physical b ON a.path = b.path AND b.line BETWEEN a.line - 1 AND a.line + 1
WHERE contains(a.text, 'idiot') GROUP BY a.path, a.line""")
def text_search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.with_context(s.files(spark, sf_dir), "idiot", 1)


@query(f"""WITH {_FILES}, {_LINES}, r AS (SELECT *, 300 - coalesce(sum(length(text) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM physical WHERE line BETWEEN 2 AND 6) SELECT path, line, substr(text, 1, CAST(room AS BIGINT)) AS text FROM r WHERE room > 0""")
def source_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.source_page(s.files(spark, sf_dir), 2, 6, 300)


@query(f"""WITH {_FILES}, {_LINES} SELECT f.path, count(p.line) AS lines, coalesce(max(length(p.text)), 0) AS longest, f.size
  FROM files f LEFT JOIN physical p ON f.path = p.path GROUP BY f.path, f.size""")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.line_stats(s.files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT path, sha256, size FROM files ORDER BY path LIMIT 200 OFFSET 100")
def manifest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.page(s.files(spark, sf_dir).select("path", "sha256", "size"), ["path"], 100, 200)


@query(f"""WITH {_FILES}, t AS (SELECT count(*) AS total FROM files)
SELECT p.*, total, total > 150 AS has_more, CASE WHEN total > 150 THEN 150 END AS next_offset FROM (SELECT path, size FROM files ORDER BY path LIMIT 100 OFFSET 50) p, t""")
def manifest_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.page_with_total(s.files(spark, sf_dir).select("path", "size"), ["path"], 50, 100)


@query(f"WITH {_FILES} SELECT sha256, any_value(size) AS size FROM files GROUP BY sha256")
def blob_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.blobs(s.files(spark, sf_dir)).select("sha256", "size")


@query(f"WITH {_FILES} SELECT f.path, b.content IS NOT NULL AS found FROM files f JOIN (SELECT sha256, any_value(content) AS content FROM files GROUP BY sha256) b USING (sha256)")
def files_with_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = s.files(spark, sf_dir)
    return snapshots.with_content(files.select("path", "sha256"), snapshots.blobs(files)).select("path", F.col("content").isNotNull().alias("found"))


@query(f"""WITH {_FILES}, projects AS (SELECT DISTINCT project_id FROM files UNION ALL SELECT 'empty')
SELECT p.project_id, count(f.path) AS files FROM projects p LEFT JOIN files f USING (project_id) GROUP BY p.project_id""")
def list_projects_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = s.files(spark, sf_dir)
    projects = files.select("project_id").distinct().unionByName(spark.createDataFrame([("empty",)], "project_id string"))
    return snapshots.project_counts(projects, files.select("project_id", "path"))


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)
SELECT page_id, path <> '' AND length(path) <= 1024 AND NOT regexp_matches(path, '[\\\\:\\x00-\\x1f\\x7f]') AND NOT regexp_matches(path, '^/|//|/$|(^|/)\\.{1,2}(/|$)') AS valid,
  len(list_filter(string_split(lower(path), '/'), lambda x: x IN ('build', 'dist', 'target', 'venv', 'node_modules', '.git') OR regexp_matches(x, '^(credentials.*|secrets.*|\\.env|.*\\.key|.*\\.pem|.*\\.db)$'))) > 0 AS excluded FROM p""")
def path_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return s.read(spark, sf_dir, "pages").select("page_id", policy.valid_path(path).alias("valid"), policy.excluded_path(path).alias("excluded"))


@query(r"""WITH f AS (SELECT doc_id, text FROM documents)
SELECT doc_id, regexp_matches(text, '-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----') OR regexp_matches(text, '\b(?:sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}|AKIA[A-Z0-9]{16})\b')
 OR regexp_matches(text, '\b(?:ghp_|github_pat_)[A-Za-z0-9_]{20,}\b') OR regexp_matches(text, '\bxox[baprs]-[A-Za-z0-9-]{20,}\b')
 OR regexp_matches(text, '(?im)^\s*(?:-\s*)?(?:spring\.datasource\.password|datasource\.password|DB_PASSWORD|POSTGRES_PASSWORD|MYSQL_PASSWORD|MYSQL_ROOT_PASSWORD|password)\s*[=:]\s*[''"]?[^''"\s#$]') AS secret FROM f""")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = s.read(spark, sf_dir, "documents")
    return d.select("doc_id", (policy.content_problem(F.col("text")) == "possible credential or private key").isNotNull().alias("secret"))


@query(f"WITH {_FILES} SELECT language, count(*) AS files FROM files GROUP BY language")
def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.histogram(s.files(spark, sf_dir), "language")


_FULL = "SELECT coalesce(a.path, b.path) AS path, a.sha256 AS old, b.sha256 AS new FROM before a FULL JOIN files b ON a.path = b.path WHERE a.sha256 IS DISTINCT FROM b.sha256"


@query(f"WITH {_FILES}, {_BEFORE}, d AS ({_FULL}) SELECT path, CASE WHEN new IS NULL THEN 'delete' ELSE 'upsert' END AS op, new AS sha256 FROM d")
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.delta(s.previous_files(spark, sf_dir), s.files(spark, sf_dir))


@query(f"WITH {_FILES}, {_BEFORE}, d AS ({_FULL}) SELECT path, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'deleted' ELSE 'modified' END AS status, old AS old_sha256, new AS new_sha256 FROM d")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.diff(s.previous_files(spark, sf_dir), s.files(spark, sf_dir))


@query(f"WITH {_FILES}, {_BEFORE}, d AS ({_FULL}) SELECT count(*) FILTER (old IS NULL) AS added, count(*) FILTER (new IS NULL) AS deleted, count(*) FILTER (old IS NOT NULL AND new IS NOT NULL) AS modified FROM d")
def snapshot_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.diff_totals(snapshots.diff(s.previous_files(spark, sf_dir), s.files(spark, sf_dir)))


_LINE_COUNTS = f"""c AS (SELECT path, doc_id, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END END AS n,
  content = '' OR ends_with(content, chr(10)) AS closed FROM files WHERE doc_id % 10 = 0 OR doc_id % 7 = 0),
counted AS (SELECT path, CASE WHEN doc_id % 10 = 0 THEN n WHEN closed THEN 0 ELSE 1 END AS insertions, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1 END AS deletions FROM c)"""


@query(f"WITH {_FILES}, {_LINE_COUNTS} SELECT * FROM counted")
def diff_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.line_counts(diff.changed_texts(s.previous_files(spark, sf_dir), s.files(spark, sf_dir)))


@query(f"WITH {_FILES}, {_LINE_COUNTS} SELECT CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions, count(*) AS files FROM counted")
def diff_line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_line_counts(spark, sf_dir).agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.count("*").alias("files"))


@query(f"""WITH {_FILES}, b AS (SELECT CASE WHEN doc_id % 11 = 0 THEN path || '.old' ELSE path END AS path, sha256 FROM files WHERE doc_id % 10 <> 0),
d AS (SELECT coalesce(b.path, f.path) AS path, b.sha256 AS old, f.sha256 AS new FROM b FULL JOIN files f ON b.path = f.path WHERE b.sha256 IS DISTINCT FROM f.sha256),
m AS (SELECT g.path AS moved_from, n.path FROM (SELECT old, min(path) AS path FROM d WHERE new IS NULL GROUP BY old HAVING count(*) = 1) g
  JOIN (SELECT new, min(path) AS path FROM d WHERE old IS NULL GROUP BY new HAVING count(*) = 1) n ON old = new)
SELECT d.path, CASE WHEN m.path IS NOT NULL THEN 'moved' WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'deleted' ELSE 'modified' END AS status, moved_from
FROM d LEFT JOIN m ON d.path = m.path WHERE d.path NOT IN (SELECT moved_from FROM m)""")
def diff_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = s.files(spark, sf_dir)
    path = F.when(F.col("doc_id") % 11 == 0, F.concat("path", F.lit(".old"))).otherwise(F.col("path"))
    return snapshots.diff_with_moves(files.where("doc_id % 10 <> 0").select(path.alias("path"), "sha256"), files)


@query()
def unified_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.patches(diff.changed_texts(s.previous_files(spark, sf_dir), s.files(spark, sf_dir)))


@query("""WITH r AS (SELECT l_orderkey AS project_id, CAST(l_linenumber AS BIGINT) AS revision, max(l_partkey) AS part FROM lineitem GROUP BY ALL)
SELECT project_id, revision, part FROM (SELECT *, dense_rank() OVER (PARTITION BY project_id ORDER BY revision DESC) AS k FROM r) WHERE k <= 2""")
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").cast("long").alias("revision")).agg(F.max("l_partkey").alias("part"))
    return snapshots.retained(rows)


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS project_id, CAST(l_linenumber AS BIGINT) AS revision FROM lineitem)
SELECT project_id, revision FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY revision DESC) AS k FROM r) WHERE k = 2""")
def previous_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").cast("long").alias("revision")).distinct()
    return snapshots.previous_revision(rows)


@query(f"WITH {_FILES}, {_BEFORE} SELECT DISTINCT sha256 FROM before WHERE sha256 NOT IN (SELECT sha256 FROM files)")
def orphan_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.orphans(snapshots.blobs(s.previous_files(spark, sf_dir)), s.files(spark, sf_dir)).select("sha256")


_SYMBOLS = """symbols AS (SELECT p_brand || '/' || p_partkey AS path, p_name AS name, p_brand || '.' || p_name AS qualname,
  CASE p_partkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'module' END AS kind, CAST(p_size AS BIGINT) AS start_line, p_type AS language, 'sym_' || p_partkey AS symbol_id FROM part)"""


@query(f"WITH {_SYMBOLS} SELECT * FROM symbols WHERE contains(lower(name), 'ed w') AND kind <> 'module'")
def symbol_search_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.symbol_search(s.symbols(spark, sf_dir), "ED w")


@query(f"WITH {_SYMBOLS} SELECT * FROM symbols WHERE name = 'blue bolt' AND kind = 'class' AND starts_with(path, 'Brand#1')")
def symbol_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.symbol_search(s.symbols(spark, sf_dir), "blue bolt", exact=True, kind="class", prefix="Brand#1")


@query(f"""WITH {_SYMBOLS}, asked AS (SELECT DISTINCT qualname FROM symbols WHERE CAST(substr(symbol_id, 5) AS BIGINT) % 100 = 0 UNION SELECT 'no such name'),
met AS (SELECT a.qualname, s.symbol_id, row_number() OVER (PARTITION BY a.qualname ORDER BY s.path, s.symbol_id) AS k FROM asked a LEFT JOIN symbols s ON s.qualname = a.qualname)
SELECT qualname, CASE count(symbol_id) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, count(symbol_id) AS candidates,
  CASE WHEN count(symbol_id) = 1 THEN min(symbol_id) END AS symbol_id, coalesce(string_agg(symbol_id, ',' ORDER BY k) FILTER (k <= 10), '') AS first FROM met GROUP BY qualname""")
def selector_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = s.symbols(spark, sf_dir)
    asked = symbols.where(F.substring("symbol_id", 5, 20).cast("long") % 100 == 0).select("qualname")
    return relations.resolve_selectors(symbols, asked.unionByName(spark.createDataFrame([("no such name",)], "qualname string")))


@query(f"""WITH RECURSIVE {_RELATIONS}, steps AS (SELECT DISTINCT src, tgt FROM relations WHERE kind = 'CALL' AND NOT type_only),
walk AS (SELECT 'n' || c_custkey AS seed, 'n' || c_custkey AS node, 0 AS distance FROM customer WHERE c_custkey % 100 = 0 UNION SELECT w.seed, s.tgt, w.distance + 1 FROM walk w JOIN steps s ON s.src = w.node WHERE w.distance < 3),
reach AS (SELECT seed, node, min(distance) AS distance FROM walk GROUP BY seed, node HAVING min(distance) < 3)
SELECT seed, src AS source_symbol_id, line, 'r' || line AS name, distance, 'not_traversed' AS reason FROM reach JOIN relations ON src = node WHERE kind = 'CALL' AND type_only""")
def call_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.call_gaps(s.relations(spark, sf_dir), s.seeds(spark, sf_dir), 3)


@query(f"""WITH {_SYMBOLS}, s AS (SELECT *, start_line + length(name) AS end_line, CAST(substr(symbol_id, 5) AS BIGINT) AS k FROM symbols),
asks AS (SELECT k AS ask, CASE WHEN k % 4 = 0 THEN symbol_id END AS symbol_id, CASE WHEN k % 4 = 1 THEN path END AS path, CASE WHEN k % 4 = 2 THEN qualname END AS qualname, CASE WHEN k % 4 = 3 THEN name END AS name,
  CASE WHEN k % 3 = 0 THEN 'class' END AS kind, CASE WHEN k % 5 = 0 THEN start_line + 2 END AS line FROM s),
m AS (SELECT a.ask, s.symbol_id, s.path, s.start_line, rank() OVER (PARTITION BY a.ask ORDER BY CASE WHEN a.line IS NOT NULL THEN s.end_line - s.start_line ELSE 0 END) AS r
  FROM asks a JOIN s ON (a.symbol_id = s.symbol_id OR a.path = s.path OR a.qualname = s.qualname OR a.name = s.name) AND (a.kind IS NULL OR a.kind = s.kind) AND (a.line IS NULL OR a.line BETWEEN s.start_line AND s.end_line)),
p AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY path, start_line, symbol_id) AS place FROM m WHERE r = 1)
SELECT a.ask, CASE count(p.symbol_id) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, count(p.symbol_id) AS candidates, CASE WHEN count(p.symbol_id) = 1 THEN min(p.symbol_id) END AS symbol_id,
  coalesce(string_agg(p.symbol_id, ',' ORDER BY place) FILTER (place <= 10), '') AS first FROM asks a LEFT JOIN p ON p.ask = a.ask GROUP BY a.ask""")
def symbol_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("symbol_id", 5, 20).cast("long")
    symbols = s.symbols(spark, sf_dir).withColumns({"end_line": F.col("start_line") + F.char_length("name"), "ask": k})
    given = lambda r, c: F.when(F.col("ask") % 4 == r, F.col(c)).alias(c)
    asks = symbols.select("ask", given(0, "symbol_id"), given(1, "path"), given(2, "qualname"), given(3, "name"), F.when(F.col("ask") % 3 == 0, "class").alias("kind"), F.when(F.col("ask") % 5 == 0, F.col("start_line") + 2).alias("line"))
    return relations.select_symbols(symbols, asks).withColumn("first", F.array_join("first", ","))


@query(f"""WITH {_RELATIONS}, e AS (SELECT source_path, target_path, count(*) AS n FROM relations WHERE source_path <> target_path GROUP BY ALL),
sides AS (SELECT source_path AS path, 'depends_on' AS section, target_path AS other, n FROM e UNION ALL SELECT target_path, 'used_by', source_path, n FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY path, section ORDER BY other) AS place, count(*) OVER (PARTITION BY path, section) AS total FROM sides
  WHERE path IN (SELECT 'n' || CAST(floor(c_custkey / 4) AS BIGINT) FROM customer WHERE c_custkey % 100 = 0))
SELECT path, section, place, other, n AS evidence_count, total FROM k WHERE place <= 5""")
def file_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = s.read(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("n"), F.floor(F.col("c_custkey") / 4).cast("string")).alias("path"))
    found = relations.file_context(relations.file_edges(s.relations(spark, sf_dir)), seeds)
    return found.select("path", "section", F.col("place").cast("long").alias("place"), "other", "evidence_count", "total")


@query(f"WITH {_RELATIONS} SELECT tgt AS target_symbol_id, src AS source_symbol_id, kind, line FROM relations WHERE kind <> 'IMPORT'")
def find_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.find_references(s.relations(spark, sf_dir), include_imports=False).select("target_symbol_id", "source_symbol_id", "kind", "line")


@query(f"""WITH {_RELATIONS}, f AS (SELECT *, row_number() OVER (PARTITION BY source_path, target_path ORDER BY line, fact_order) AS k FROM relations WHERE source_path <> target_path OR kind = 'IMPORT')
SELECT source_path AS source, target_path AS target, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, count(*) AS evidence_count, bool_and(type_only) AS type_only,
  string_agg(kind || ':' || line, ',' ORDER BY k) FILTER (k <= 5) AS evidence FROM f GROUP BY source_path, target_path""")
def file_edges_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relations.file_edges(s.relations(spark, sf_dir))
    shown = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["kind"], e["line"].cast("string"))), ",")
    return found.select("source", "target", F.array_join("kinds", ",").alias("kinds"), "evidence_count", "type_only", shown.alias("evidence"))


@query(f"""WITH {_RELATIONS}, seeds AS (SELECT 'n' || c_custkey AS node FROM customer WHERE c_custkey % 100 = 0),
sides AS (SELECT node, 'out' AS side, r.* FROM relations r JOIN seeds ON src = node UNION ALL SELECT node, 'in' AS side, r.* FROM relations r JOIN seeds ON tgt = node WHERE src <> tgt)
SELECT node, side, src AS source_symbol_id, tgt AS target_symbol_id, line, place FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY source_path, line, kind, fact_order) AS place FROM sides) WHERE place <= 3""")
def frontier_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relations.frontier_edges(s.relations(spark, sf_dir), s.seeds(spark, sf_dir), ("CALL", "IMPORT"), 3)
    return found.select("node", "side", "source_symbol_id", "target_symbol_id", "line", F.col("place").cast("long").alias("place"))


def _walk(pairs: str, depth: int) -> str:
    return f"""WITH RECURSIVE {_RELATIONS}, pairs AS ({pairs}), walk AS (SELECT 'n' || c_custkey AS seed, 'n' || c_custkey AS node, 0 AS distance FROM customer WHERE c_custkey % 100 = 0
 UNION SELECT w.seed, p.tgt, w.distance + 1 FROM walk w JOIN pairs p ON w.node = p.src WHERE w.distance < {depth})
SELECT seed, node, min(distance) AS distance FROM walk GROUP BY seed, node"""


_OUT, _IN = "SELECT src, tgt FROM edges", "SELECT tgt AS src, src AS tgt FROM edges"


@query(_walk(_OUT, 4))
def graph_out_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distances(s.edges(spark, sf_dir), s.seeds(spark, sf_dir), 4)


@query(_walk(_IN, 4))
def graph_in_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distances(s.edges(spark, sf_dir), s.seeds(spark, sf_dir), 4, "incoming")


@query(_walk(f"{_OUT} UNION {_IN}", 3))
def graph_both_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distances(s.edges(spark, sf_dir), s.seeds(spark, sf_dir), 3, "both")


@query(f"""WITH RECURSIVE {_RELATIONS}, pairs AS (SELECT DISTINCT target_path AS src, source_path AS tgt FROM relations WHERE source_path <> target_path OR kind = 'IMPORT'),
walk AS (SELECT 'n' || (c_custkey // 4) AS seed, 'n' || (c_custkey // 4) AS node, 0 AS distance FROM customer WHERE c_custkey % 100 = 0
 UNION SELECT w.seed, p.tgt, w.distance + 1 FROM walk w JOIN pairs p ON w.node = p.src WHERE w.distance < 3)
SELECT seed, node, min(distance) AS distance FROM walk GROUP BY seed, node""")
def impact_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = relations.file_pairs(s.relations(spark, sf_dir))
    seeds = s.read(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("n"), F.floor(F.col("c_custkey") / 4).cast("string")).alias("node"))
    return graph.distances(edges, seeds.distinct(), 3, "incoming")


@query(f"""WITH RECURSIVE {_RELATIONS}, walk AS (SELECT 'n' || c_custkey AS source, 'n' || c_custkey AS node, 0 AS length, 'n' || c_custkey AS path FROM customer WHERE c_custkey % 100 = 0
 UNION ALL SELECT w.source, p.tgt, w.length + 1, w.path || '>' || p.tgt FROM walk w JOIN edges p ON w.node = p.src WHERE w.length < 4),
best AS (SELECT source, node, min(length) AS length FROM walk GROUP BY source, node)
SELECT w.source, w.node AS target, w.length, w.path FROM walk w JOIN best b ON w.source = b.source AND w.node = b.node AND w.length = b.length
QUALIFY row_number() OVER (PARTITION BY w.source, w.node ORDER BY string_split(w.path, '>')) <= 10""")
def call_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.shortest_paths_from(s.edges(spark, sf_dir), s.seeds(spark, sf_dir), 4)
    return found.select("source", "target", "length", F.array_join("path", ">").alias("path"))


@query(f"""WITH RECURSIVE {_RELATIONS}, nodes AS (SELECT src AS node FROM edges UNION SELECT tgt FROM edges),
reach AS (SELECT src AS a, tgt AS b FROM edges UNION SELECT r.a, e.tgt FROM reach r JOIN edges e ON r.b = e.src)
SELECT n.node, greatest(n.node, max(x.b)) AS scc FROM nodes n LEFT JOIN (SELECT r.a, r.b FROM reach r JOIN reach q ON r.a = q.b AND r.b = q.a) x ON x.a = n.node GROUP BY n.node""")
def scc_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(s.edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_RELATIONS}, nodes AS (SELECT src AS node FROM edges UNION SELECT tgt FROM edges),
reach AS (SELECT src AS a, tgt AS b FROM edges UNION SELECT r.a, e.tgt FROM reach r JOIN edges e ON r.b = e.src),
groups AS (SELECT n.node, greatest(n.node, max(x.b)) AS scc FROM nodes n LEFT JOIN (SELECT r.a, r.b FROM reach r JOIN reach q ON r.a = q.b AND r.b = q.a) x ON x.a = n.node GROUP BY n.node),
dag AS (SELECT DISTINCT g.scc AS a, h.scc AS b FROM edges JOIN groups g ON g.node = src JOIN groups h ON h.node = tgt WHERE g.scc <> h.scc),
deep AS (SELECT DISTINCT scc, 0 AS layer FROM groups UNION SELECT a, layer + 1 FROM deep JOIN dag ON b = scc),
loops AS (SELECT scc, count(*) > 1 OR bool_or(node IN (SELECT src FROM edges WHERE src = tgt)) AS cyclic FROM groups GROUP BY scc)
SELECT node, g.scc, max(layer) AS layer, any_value(cyclic) AS cyclic FROM groups g JOIN deep d ON d.scc = g.scc JOIN loops l ON l.scc = g.scc GROUP BY node, g.scc""")
def architecture_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.layers(s.edges(spark, sf_dir))


@query("""WITH RECURSIVE p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), parts AS (SELECT page_id, path, string_split(path, '/') AS w FROM p),
up AS (SELECT page_id, path, unnest(range(1, len(w))) AS k, w FROM parts), dirs AS (SELECT page_id, path, k, array_to_string(w[1:k], '/') AS directory FROM up),
marked AS (SELECT DISTINCT directory FROM dirs WHERE length(directory) % 2 = 0)
SELECT path, max_by(directory, k) AS directory FROM dirs WHERE directory IN (SELECT directory FROM marked) GROUP BY path""")
def nearest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.text import parent_dirs

    path = F.regexp_replace("url", "^[a-z]+://", "")
    paths = s.read(spark, sf_dir, "pages").select(path.alias("path"), F.lit("python").alias("language")).distinct()
    dirs = paths.select(F.explode(parent_dirs(F.col("path"))).alias("directory"), "language").distinct().where("directory <> '.' and length(directory) % 2 = 0")
    return dependencies.nearest_manifest(paths, dirs)


@query("""WITH p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), w AS (SELECT path, string_split(path, '/') AS w FROM p),
d AS (SELECT path, unnest(range(1, len(w))) AS k, w FROM w), dirs AS (SELECT path, k, array_to_string(w[1:k], '/') AS directory FROM d),
best AS (SELECT path, max_by(directory, k) AS root FROM dirs WHERE length(directory) % 3 = 0 GROUP BY path)
SELECT path, root, replace(substr(path, length(root) + 2), '/', '.') AS module FROM best""")
def source_root_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.text import parent_dirs

    paths = s.read(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()
    roots = paths.select(F.explode(parent_dirs(F.col("path"))).alias("directory")).where("directory <> '.' and length(directory) % 3 = 0")
    return dependencies.module_under_roots(paths, roots)


@query("""WITH u AS (SELECT CASE l_partkey % 2 WHEN 0 THEN 'python' ELSE 'java' END AS language, 'm' || (l_partkey % 50) AS module, l_returnflag AS dependency_kind, 'f' || (l_orderkey % 97) AS path, CAST(l_linenumber AS BIGINT) AS line, l_orderkey FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY language, module, dependency_kind ORDER BY path, line) AS place FROM u)
SELECT language, module, dependency_kind, count(*) AS usage_count, string_agg(path || ':' || line, ',' ORDER BY path, line) FILTER (place <= 10) AS used_by FROM k GROUP BY ALL""")
def dependency_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c, n, t: F.concat(F.lit(t), (F.col(c) % n).cast("string"))
    rows = s.read(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_partkey") % 2 == 0, "python").otherwise("java").alias("language"), text("l_partkey", 50, "m").alias("module"),
        F.col("l_returnflag").alias("dependency_kind"), text("l_orderkey", 97, "f").alias("path"), F.col("l_linenumber").cast("long").alias("line"),
    )
    used = F.array_join(F.transform("used_by", lambda u: F.concat_ws(":", u["path"], u["line"].cast("string"))), ",")
    return dependencies.dependency_groups(rows).withColumn("used_by", used)


#: Modules that imports are planted with: of the platforms, of known distributions, near misses of both, and local ones.
_MODULES = (
    ("python", "os.path"), ("python", "yaml.nodes"), ("python", "yamlx"), ("python", "PIL"), ("python", "numpy.linalg"), ("python", "local_pkg.sub"), ("python", "nowhere"),
    ("java", "java.util.List"), ("java", "javax.xml.bind.Element"), ("java", "javax.xml.parsers.Parser"), ("java", "javax.security.auth.Subject"), ("java", "javaxx.sql"),
    ("java", "org.junit.jupiter.api.Test"), ("java", "org.springframework.stereotype.Service"), ("java", "com.google.common.base.Strings"), ("java", "org.slf4jx.Logger"),
)
_DECLARED = (
    ("python", "python_distribution", "pyyaml"), ("python", "python_local_distribution", "pyyaml"), ("python", "python_distribution", "pillow"), ("python", "python_local_distribution", "numpy"),
    ("java", "java_artifact", "junit:junit"), ("java", "java_artifact", "org.springframework:spring-context"), ("java", "java_artifact", "com.google.guava:guava"), ("java", "diagnostic", "MANIFEST_TOO_LARGE"),
)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)


@query(f"""WITH planted(k, language, module) AS (VALUES {_values((k, *m) for k, m in enumerate(_MODULES))}), declared(k, language, kind, name) AS (VALUES {_values((k, *d) for k, d in enumerate(_DECLARED))}),
provides(language, name, prefix) AS (VALUES {_values([("python", d, m) for d, ms in PYTHON_MODULES.items() for m in ms] + [("java", d, m) for d, ms in JAVA_PACKAGES.items() for m in ms])}),
standard(prefix) AS (VALUES {_values((p,) for p in JAVA_STANDARD)}), builtin(top) AS (VALUES {_values((m,) for m in sorted(sys.stdlib_module_names))}),
imports AS (SELECT l_orderkey AS o, l_linenumber AS n, 'd' || (l_suppkey % 9) || '/p' || (l_partkey % 3) || '/m' AS path, language, module,
  CASE WHEN l_partkey % 23 = 0 THEN 'here' END AS target_path, CASE WHEN l_partkey % 29 = 0 THEN '.' ELSE '' END || module AS name FROM lineitem JOIN planted ON k = l_partkey % {len(_MODULES)}),
manifests AS (SELECT DISTINCT 'd' || (s_suppkey % 9) || CASE WHEN s_suppkey % 4 = 0 THEN '/p1' ELSE '' END AS directory, language, kind, name FROM supplier JOIN declared ON k = s_suppkey % {len(_DECLARED)}),
near AS (SELECT path, i.language, max(directory) AS directory FROM (SELECT DISTINCT path, language FROM imports) i JOIN manifests m ON m.language = i.language AND starts_with(path, directory || '/') GROUP BY ALL),
known AS (SELECT directory, m.language, p.module, min(CASE WHEN kind = 'python_local_distribution' THEN '0' ELSE '1' END || m.name) AS best FROM planted p JOIN provides v ON v.language = p.language AND (p.module = prefix OR starts_with(p.module, prefix || '.'))
  JOIN manifests m ON m.language = v.language AND m.name = v.name AND kind <> 'diagnostic' GROUP BY ALL),
judged AS (SELECT i.*, best, target_path IS NOT NULL OR (i.language = 'python' AND starts_with(i.name, '.')) AS certain, split_part(i.module, '.', 1) = 'local_pkg' AS local,
  CASE i.language WHEN 'python' THEN split_part(i.module, '.', 1) IN (FROM builtin) ELSE EXISTS (SELECT 1 FROM standard s WHERE i.module = s.prefix OR starts_with(i.module, s.prefix || '.')) END AS platform
  FROM imports i LEFT JOIN near r ON r.path = i.path AND r.language = i.language LEFT JOIN known k ON k.directory = r.directory AND k.language = i.language AND k.module = i.module)
SELECT o, n, path, module, CASE WHEN certain OR local THEN 'local_module' WHEN platform THEN 'standard_library' WHEN best[1] = '0' THEN 'local_module' WHEN best[1] = '1' THEN 'third_party' ELSE 'unknown' END AS dependency_kind,
  CASE WHEN certain THEN 'high' WHEN local THEN 'medium' WHEN platform THEN 'high' WHEN best[1] = '0' THEN 'medium' WHEN best[1] = '1' THEN 'high' ELSE 'unknown' END AS confidence,
  CASE WHEN NOT certain AND NOT local AND NOT platform THEN substr(best, 2) END AS declaration FROM judged""")
def dependency_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = F.broadcast(spark.createDataFrame([(k, *m) for k, m in enumerate(_MODULES)], "k long, language string, module string"))
    declared = F.broadcast(spark.createDataFrame([(k, *d) for k, d in enumerate(_DECLARED)], "k long, language string, kind string, name string"))
    text = lambda c, n, t: F.concat(F.lit(t), (F.col(c) % n).cast("string"))
    lines = s.read(spark, sf_dir, "lineitem").join(planted, F.col("k") == F.col("l_partkey") % len(_MODULES))
    imports = lines.select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.concat(text("l_suppkey", 9, "d"), text("l_partkey", 3, "/p"), F.lit("/m")).alias("path"), "language", "module",
        F.when(F.col("l_partkey") % 23 == 0, "here").alias("target_path"), F.concat(F.when(F.col("l_partkey") % 29 == 0, ".").otherwise(""), F.col("module")).alias("name"),
    )
    rows = s.read(spark, sf_dir, "supplier").join(declared, F.col("k") == F.col("s_suppkey") % len(_DECLARED))
    manifests = rows.select(F.concat(text("s_suppkey", 9, "d"), F.when(F.col("s_suppkey") % 4 == 0, "/p1").otherwise("")).alias("directory"), "language", "kind", "name").distinct()
    modules = spark.createDataFrame([("local_pkg.sub",)], "module string")
    return dependencies.classify(imports, manifests, modules).select("o", "n", "path", "module", "dependency_kind", "confidence", "declaration")


_INDEXED = "indexed AS (SELECT path, CASE doc_id % 3 WHEN 1 THEN 'ready' ELSE 'partial' END AS status FROM files WHERE doc_id % 5 <> 0)"


def _indexed(files: DataFrame) -> DataFrame:
    return files.where("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 3 == 1, "ready").otherwise("partial").alias("status"))


@query(f"""WITH {_FILES}, {_INDEXED} SELECT count(*) AS known, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status <> 'ready') AS limited,
  count(*) FILTER (status IS NULL) AS unindexed FROM files LEFT JOIN indexed USING (path)""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = s.files(spark, sf_dir)
    return coverage.coverage(files, _indexed(files))


@query(f"""WITH {_FILES}, {_INDEXED}, c AS (SELECT path, CASE WHEN status IS NULL THEN 'unindexed' WHEN status = 'ready' THEN 'ready' ELSE 'limited' END AS category FROM files LEFT JOIN indexed USING (path)),
t AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY path) AS turn FROM c)
SELECT path, category, turn FROM t ORDER BY turn, CASE category WHEN 'ready' THEN 0 WHEN 'limited' THEN 1 ELSE 2 END LIMIT 12""")
def coverage_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = s.files(spark, sf_dir)
    return coverage.interleaved_sample(files, _indexed(files)).withColumn("turn", F.col("turn").cast("long"))


@query("SELECT user_id AS job_id, max(ts) AS updated, max(event_id) AS seq, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id")
def job_ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.latest(s.jobs(spark, sf_dir), "job_id", ["updated", "seq"], ["state"])


@query("SELECT event_id AS seq, user_id AS job_id FROM events WHERE ts < TIMESTAMP '2024-01-10' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-25')")
def expired_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = s.jobs(spark, sf_dir)
    used = jobs.where("state = 'signup' and updated >= timestamp '2024-01-25'").select("job_id").distinct()
    return journal.expired(jobs, used, "job_id", "updated", "2024-01-10").select("seq", "job_id")


@query("SELECT event_id AS seq, user_id AS job_id, event_type AS state FROM events ORDER BY CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END, ts DESC, user_id, event_id LIMIT 100")
def active_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.active_first(s.jobs(spark, sf_dir), ("view", "click"), 100).select("seq", "job_id", "state")


@query("""WITH k AS (SELECT user_id AS project_id, event_id AS context, sum(abs(value)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM events)
SELECT project_id, context FROM k WHERE held > 500""")
def lru_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.read(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("context"), "ts", F.abs("value").alias("size"))
    return journal.lru_victims(rows, "project_id", "ts", "size", "context", 500).select("project_id", "context")


@query("""WITH k AS (SELECT user_id AS project_id, event_id AS context, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events
  WHERE ts <= TIMESTAMP '2024-01-15' AND ts + INTERVAL 86400 SECOND > TIMESTAMP '2024-01-15') SELECT project_id, context FROM k WHERE place <= 3""")
def live_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.read(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("context"), "ts")
    return journal.live_contexts(rows, "project_id", "ts", "context", "2024-01-15", 86_400, 3).select("project_id", "context")


@query("""SELECT conv_id AS job_id, CAST(turn AS BIGINT) AS seq, CAST(strlen(text) AS BIGINT) AS size,
  CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations""")
def log_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.with_offsets(s.chunks(spark, sf_dir)).select("job_id", "seq", "size", "start")


@query(r"""WITH c AS (SELECT conv_id AS job_id, CAST(turn AS BIGINT) AS seq, hex(encode(text)) AS h, CAST(strlen(text) AS BIGINT) AS size,
  CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM conversations),
b AS (SELECT *, unnest(range(greatest(0, 100 - off), least(size, 1100 - off))) AS i FROM c WHERE off < 1100 AND off + size > 100),
k AS (SELECT *, max(CASE WHEN substr(h, 2 * i + 1, 1) NOT IN ('8', '9', 'A', 'B') THEN i END) OVER (PARTITION BY job_id, seq ORDER BY i) AS head FROM b),
w AS (SELECT *, CASE WHEN substr(h, 2 * head + 1, 1) < '8' THEN 1 WHEN substr(h, 2 * head + 1, 1) IN ('C', 'D') THEN 2 WHEN substr(h, 2 * head + 1, 1) = 'E' THEN 3 ELSE 4 END AS width FROM k WHERE head IS NOT NULL)
SELECT job_id, seq, off + min(i) AS start, decode(unhex(string_agg(substr(h, 2 * i + 1, 2), '' ORDER BY i))) AS text FROM w WHERE off + head + width <= 1100 GROUP BY job_id, seq, off""")
def log_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.read_range(s.chunks(spark, sf_dir), 100, 1000).select("job_id", "seq", "start", F.decode("data", "UTF-8").alias("text"))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id AS job_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM i GROUP BY user_id, k""")
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.idle_sessions(s.jobs(spark, sf_dir), "job_id", "updated", 6 * 3600)


_PARTS = ("edges", "symbols", "unresolved", "paths")


@query(f"""WITH i AS (SELECT l_orderkey // 20 AS request, list_extract({list(_PARTS)}, 1 + l_partkey % 4) AS section, CAST(l_quantity AS BIGINT) AS chars, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem),
n AS (SELECT request, section, chars, row_number() OVER (PARTITION BY request, section ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, chars) AS place FROM i),
l AS (SELECT *, chars + 2 AS size, CASE WHEN place > CASE section WHEN 'unresolved' THEN 0 ELSE 1 END THEN 0 WHEN section IN ('edges', 'paths') THEN 1 ELSE 2 END AS layer FROM n),
g AS (SELECT request, section, layer, sum(size) AS gives FROM l GROUP BY ALL),
a AS (SELECT *, sum(gives) OVER (PARTITION BY request) AS total, coalesce(sum(gives) OVER (PARTITION BY request ORDER BY layer, gives DESC, section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  coalesce(sum(CASE WHEN layer < 2 THEN gives END) OVER (PARTITION BY request), 0) AS can FROM g),
q AS (SELECT request, section, layer, CASE WHEN layer < 2 AND total > 900 THEN greatest(0, least(gives, total - 900 + 96 - before)) ELSE 0 END AS quota,
  CASE WHEN total <= 900 THEN 'ready' WHEN total - can > 900 THEN 'exceeded' ELSE 'clipped' END AS status FROM a)
SELECT request, section, place, coalesce(sum(size) OVER (PARTITION BY request, section, layer ORDER BY place DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= quota AS kept, status FROM l JOIN q USING (request, section, layer)""")
def sectioned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.read(spark, sf_dir, "lineitem").withColumns({"request": F.floor(F.col("l_orderkey") / 20), "section": F.get(F.array(*map(F.lit, _PARTS)), (F.col("l_partkey") % 4).cast("int")), "chars": F.col("l_quantity").cast("long")})
    place = F.row_number().over(Window.partitionBy("request", "section").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "chars"))
    return sections.fit_sections(rows.select("request", "section", "chars", place.cast("long").alias("place")), 900).drop("chars")


@query(f"""WITH {_FILES}, {_LINES}, r AS (SELECT doc_id // 4 AS request, doc_id % 4 AS item, path, 1 + doc_id % 3 AS start_line, 6 + doc_id % 5 AS end_line, doc_id % 7 AS skip FROM files),
m AS (SELECT request, item, r.path, line, CASE WHEN line = start_line THEN substr(text, skip + 1) ELSE text END AS text FROM physical p JOIN r ON r.path = p.path AND line BETWEEN start_line AND end_line),
k AS (SELECT *, 800 - coalesce(sum(length(text) + 1) OVER (PARTITION BY request ORDER BY item, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM m)
SELECT request, item, path, line, substr(text, 1, CAST(room AS BIGINT)) AS text, length(text) <= room AS full FROM k WHERE room > 0""")
def batch_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, k = s.files(spark, sf_dir), F.col("doc_id")
    asked = files.select(F.floor(k / 4).alias("request"), (k % 4).alias("item"), "path", (1 + k % 3).alias("start_line"), (6 + k % 5).alias("end_line"), (k % 7).cast("int").alias("char_offset"))
    return sections.read_ranges(files.select("path", "content"), asked, 800).drop("first_char")


_BUDGET = 100_000


@query(f"""WITH RECURSIVE {_FILES}, f AS (SELECT project_id, path, size, row_number() OVER (PARTITION BY project_id ORDER BY path) AS k FROM files),
w AS (SELECT DISTINCT project_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS path, false AS admitted FROM files
 UNION ALL SELECT f.project_id, f.k, CASE WHEN w.used + f.size <= {_BUDGET} THEN w.used + f.size ELSE w.used END, f.path, w.used + f.size <= {_BUDGET} FROM w JOIN f ON f.project_id = w.project_id AND f.k = w.k + 1)
SELECT project_id, path, admitted FROM w WHERE k > 0""")
def parse_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.admit(s.files(spark, sf_dir).select("project_id", "path", "size"), _BUDGET).drop("size")


_LOG = """log AS (SELECT user_id AS task, event_id AS seq, 'r' || (event_id // 3) AS request, event_type AS digest,
  CASE WHEN event_id % 41 = 0 THEN 'finish' WHEN event_id % 43 = 0 THEN 'roll_back' ELSE list_extract(['begin', 'prepare', 'commit', 'abandon'], 1 + event_id % 4) END AS op FROM events),
marked AS (SELECT *, row_number() OVER w > 1 AS again, first_value(digest) OVER w = digest AS same FROM log WINDOW w AS (PARTITION BY task, request ORDER BY seq)),
told AS (SELECT *, CASE WHEN again AND same THEN 'replay' WHEN again THEN 'conflict' END AS repeat, row_number() OVER (PARTITION BY task ORDER BY seq) AS k FROM marked),
moves(op, here, there) AS (VALUES {moves}),
run AS (SELECT task, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS VARCHAR) AS repeat, 'none' AS before, 'none' AS state FROM (SELECT DISTINCT task FROM told)
 UNION ALL SELECT t.task, t.k, t.seq, t.op, t.repeat, r.state, CASE WHEN t.repeat IS NULL THEN coalesce(m.there, r.state) ELSE r.state END
 FROM run r JOIN told t ON t.task = r.task AND t.k = r.k + 1 LEFT JOIN moves m ON m.op = t.op AND m.here = r.state)""".replace(
    "{moves}", ", ".join(f"('{op}', '{a}', '{b}')" for op, moves in tasks.MOVES.items() for a, b in moves.items())
)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = s.read(spark, sf_dir, "events"), F.col("event_id")
    op = F.when(k % 41 == 0, "finish").when(k % 43 == 0, "roll_back").otherwise(F.get(F.array(*map(F.lit, ("begin", "prepare", "commit", "abandon"))), (k % 4).cast("int")))
    return e.select(F.col("user_id").alias("task"), k.alias("seq"), F.concat(F.lit("r"), F.floor(k / 3).cast("string")).alias("request"), F.col("event_type").alias("digest"), op.alias("op"))


@query(f"WITH RECURSIVE {_LOG} SELECT task, arg_max(state, k) AS state FROM run GROUP BY task")
def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.task_states(tasks.once(_log(spark, sf_dir)).where("repeat is null"))


@query(f"WITH RECURSIVE {_LOG} SELECT task, seq, op, repeat, before, before <> state AS accepted FROM run WHERE k > 0")
def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.task_log(_log(spark, sf_dir)).select("task", "seq", "op", "repeat", "before", "accepted")


_ENDS = "ends AS (SELECT l_orderkey AS o, count(*) AS n, max(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey)"


@query(f"""WITH {_ENDS}, l AS (SELECT l_orderkey // 50 AS task, l_orderkey AS o, CASE WHEN l_orderkey % 3 > 0 THEN 'o' || l_orderkey || '/0' END AS origin, CASE WHEN flag <> 'R' THEN 'o' || l_orderkey || '/' || (n % 3) END AS current
  FROM (SELECT DISTINCT l_orderkey FROM lineitem) JOIN ends ON o = l_orderkey)
SELECT task, coalesce(current, origin) AS path, CASE WHEN origin IS NOT NULL AND current IS NOT NULL AND origin <> current THEN origin END AS from_path,
  CASE WHEN origin IS NULL THEN 'add' WHEN current IS NULL THEN 'delete' WHEN origin <> current THEN 'move' ELSE 'modify' END AS op,
  origin IS NOT NULL AND current IS NOT NULL AND o % 2 = 0 AS changed FROM l WHERE (origin IS NOT NULL OR current IS NOT NULL) AND NOT (origin IS NOT NULL AND current IS NOT NULL AND origin = current AND o % 2 = 1)""")
def task_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file an order, renamed once for each of its lines among three names; some are made by the task, some deleted at the end."""
    n, o = F.col("n"), F.col("l_orderkey")
    name = lambda k: F.concat(F.lit("o"), o.cast("string"), F.lit("/"), (k % 3).cast("string"))
    task = F.floor(o / 50)
    ends = s.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_returnflag").alias("flag"))
    moves = ends.select("l_orderkey", F.explode(F.sequence(F.lit(1), n)).alias("n")).select(task.alias("task"), (o * 100 + n).alias("seq"), name(n - 1).alias("source"), name(n).alias("target"))
    made = ends.where("l_orderkey % 3 = 0").select(task.alias("task"), (o * 100).alias("seq"), F.lit(None).cast("string").alias("source"), name(F.lit(0)).alias("target"))
    gone = ends.where("flag = 'R'").select(task.alias("task"), (o * 100 + 99).alias("seq"), name(n).alias("source"), F.lit(None).cast("string").alias("target"))
    held = lambda path, sha: (task.alias("task"), path.alias("path"), sha.alias("sha256"), F.lit(False).alias("binary"))
    before = ends.where("l_orderkey % 3 > 0").select(*held(name(F.lit(0)), F.lit("a")))
    after = ends.where("flag <> 'R'").select(*held(name(n), F.when(o % 2 == 0, "b").otherwise("a")))
    return tasks.task_changes(moves.unionByName(made).unionByName(gone), before, after).select("task", "path", "from_path", "op", "changed")


@query("""WITH c AS (SELECT user_id AS project_id FROM events WHERE event_type = 'error'), n AS (SELECT count(*) AS n FROM c), p AS (SELECT DISTINCT user_id AS project_id FROM events)
SELECT l AS changes_held, project_id FROM p, n, (VALUES (1000000), (100)) x(l) WHERE n > l OR project_id IN (FROM c)""")
def dirty_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With room for all errors as changes only their projects are dirty, with room for a hundred all projects are."""
    jobs = s.jobs(spark, sf_dir)
    changes, projects = jobs.where("state = 'error'").select(F.col("job_id").alias("project_id")), jobs.select(F.col("job_id").alias("project_id")).distinct()
    room = lambda n: journal.dirty_projects(changes, projects, n).select(F.lit(n).alias("changes_held"), "project_id")
    return room(1_000_000).unionByName(room(100))


@query(f"""WITH {_RELATIONS}, nodes AS (SELECT src AS node FROM edges UNION SELECT tgt FROM edges)
SELECT 'src/pkg/' || node || '.py' AS path, 'f_' || node AS qualname, 'function' AS kind FROM nodes""")
def py_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bind.symbols_of(extract(s.python_files(spark, sf_dir), ("symbols",)))
    return found.where("kind <> 'module'").select("path", "qualname", "kind")


@query(f"""WITH {_RELATIONS}
SELECT 'src/pkg/' || src || '.py' AS source_path, 'CALL' AS kind, 'f_' || src AS source_qualname, 'src/pkg/' || tgt || '.py' AS target_path, 'f_' || tgt AS target_qualname, 'resolved' AS resolution FROM edges
UNION ALL SELECT 'src/pkg/' || src || '.py', 'IMPORT', '', 'src/pkg/' || tgt || '.py', 'f_' || tgt, 'resolved' FROM edges WHERE src <> tgt""")
def py_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bind.relations(extract(s.python_files(spark, sf_dir), BINDING_LISTS))
    return found.where("kind in ('CALL', 'IMPORT')").select("source_path", "kind", "source_qualname", "target_path", "target_qualname", "resolution")


@query()
def value_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = materialize(extract(s.python_files(spark, sf_dir)), "python-facts")
    return flow.flow_edges(facts, bind.bound_calls(facts))


@query()
def value_flow_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = materialize(extract(s.python_files(spark, sf_dir)), "python-facts")
    edges = materialize(flow.flow_edges(facts, bind.bound_calls(facts)), "flow-edges")
    values = s.seeds(spark, sf_dir).select(F.concat(F.lit("src/pkg/"), F.col("node"), F.lit(".py|f_"), F.col("node"), F.lit("|param x|0|0")).alias("node"))
    return flow.impact(edges, values, 5)


@query()
def value_flow_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = materialize(extract(s.python_files(spark, sf_dir)), "python-facts")
    edges = materialize(flow.flow_edges(facts, bind.bound_calls(facts)), "flow-edges")
    values = s.seeds(spark, sf_dir).select(F.concat(F.lit("src/pkg/"), F.col("node"), F.lit(".py|f_"), F.col("node"), F.lit("|param x|0|0")).alias("node"))
    return flow.matched_impact(edges, values)


@query(f"""WITH {_RELATIONS}, e AS (SELECT src, tgt, CAST(substr(src, 2) AS BIGINT) % 50 = 0 AS own, CAST(substr(tgt, 2) AS BIGINT) % 50 = 0 AS renamed FROM edges),
p AS (SELECT *, 'src/pkg/' || src || '.py' AS source_path, CASE WHEN own THEN 'g_' ELSE 'f_' END || src AS caller, 'src/pkg/' || tgt || '.py' AS there FROM e),
rows AS (SELECT source_path, 'CALL' AS kind, caller AS source_qualname, CASE WHEN NOT renamed THEN there END AS target_path, CASE WHEN NOT renamed THEN 'f_' || tgt END AS target_qualname,
  CASE WHEN NOT renamed THEN 'resolved' WHEN src = tgt THEN 'unresolved' ELSE 'unavailable' END AS resolution FROM p
 UNION ALL SELECT source_path, 'IMPORT', '', there, CASE WHEN NOT renamed THEN 'f_' || tgt END, 'resolved' FROM p WHERE src <> tgt),
stale AS (SELECT source_path FROM p WHERE own OR renamed)
SELECT rows.*, source_path IN (FROM stale) AS bound_anew FROM rows""")
def rebinding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth module renames its function: what binding says afterwards, and which files it had to look at."""
    files = materialize(s.python_files(spark, sf_dir), "python-files")
    renamed = F.regexp_extract("path", "n([0-9]+)", 1).cast("long") % 50 == 0
    after = files.withColumn("now", F.when(renamed, F.replace("content", F.lit("def f_"), F.lit("def g_"))).otherwise(F.col("content")))
    before = bind.binding(extract(files, BINDING_LISTS))
    # Facts of a text that is the same as before are those of before.
    edited = materialize(extract(after.where("now <> content").select("path", F.col("now").alias("content")), BINDING_LISTS), "edited-facts")
    paths = edited.select("path")
    facts = before.facts.join(maybe_broadcast(paths, paths.count()), "path", "left_anti").unionByName(edited)
    now, stale = bind.rebind(before, facts)
    rows = now.relations.where("kind in ('CALL', 'IMPORT')").select("source_path", "kind", "source_qualname", "target_path", "target_qualname", "resolution")
    return rows.join(stale.select(F.col("path").alias("source_path"), F.lit(True).alias("new")), "source_path", "left").select(*rows.columns, F.coalesce("new", F.lit(False)).alias("bound_anew"))


@query(f"WITH {_FILES}, {_BEFORE}, d AS ({_FULL}) SELECT d.path, CASE WHEN new IS NULL THEN 'delete' ELSE 'upsert' END AS op, f.content FROM d LEFT JOIN files f ON d.path = f.path")
def change_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = cdc.prepare_batch(s.files(spark, sf_dir), s.previous_files(spark, sf_dir))
    return batch if batch is not None else spark.createDataFrame([], cdc.CHANGES)


@query(f"""WITH {_FILES}, d AS (SELECT sha256(path || chr(0) || sha256) AS d FROM files)
SELECT sha256(count(*) || ':' || """ + " || ':' || ".join(f"coalesce(sum(CAST('0x' || substr(d, {1 + 16 * k}, 15) AS HUGEINT)), 0)" for k in range(4)) + """) AS digest FROM d""")
def inventory_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.inventory_digest(s.files(spark, sf_dir))


@query(f"""WITH {_RELATIONS}, nodes AS (SELECT src AS node FROM edges UNION SELECT tgt FROM edges)
SELECT 'src/pkg/' || node || '.py' AS path, '' AS qualname, 'module' AS kind, NULL AS parent FROM nodes UNION ALL SELECT 'src/pkg/' || node || '.py', 'f_' || node, 'function', '' FROM nodes""")
def python_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(extract(s.python_files(spark, sf_dir), ("scopes",)), "scopes").select("path", "qualname", "kind", "parent")
