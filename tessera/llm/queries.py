"""The contract queries ``opN_name`` and their SQL. Each derives its columns from the operator's result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import clustering, exact_dedup, fill_middle, line_dedup, lm_scoring, mixing, packing, quality_classifier, quality_rules, secrets, simhash_dedup, substring_dedup, toxicity
from tessera.llm.hashing import held_out
from tessera.llm.sampling import MOD, REMAINDER

#: Name of the tokenizer's vocabulary file, looked up where it is installed.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))
    return scored.select("doc_id", held_out("doc_id", MOD, REMAINDER).alias("held_out"), "score", "predicted")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).drop("rid")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary_path())


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.classify(documents(spark, sf_dir), labels(spark, sf_dir))
    return scored.select("doc_id", held_out("doc_id", MOD, REMAINDER).alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir)).drop("lang", "source", "n_lines")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_middle(documents(spark, sf_dir)).withColumn("output_sha256", F.sha2("output", 256))
    return fill_middle.restored(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    joined = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(joined, 256).alias("centroid_sha256"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    base = F.filter("found", lambda f: F.size(f["route"]) == 0)
    joined = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined("found").alias("spans"), "n_unread")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_simhash_dedup, op3_substring_dedup, op4_exact_dedup, op5_lm_scoring, op6_source_mixing, op7_packing, op8_quality_classifier, op9_quality_rules, op10_line_dedup, op11_fill_middle, op12_centroid_clustering, op13_secret_scan, pipeline)
}

_EXACT_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM t WINDOW same AS (PARTITION BY body)
"""

_LINE_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split),
keyed AS (SELECT doc_id, line, pos,
  translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM keyed k LEFT JOIN owners o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_MIDDLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || doc_id) AS hash FROM documents),
h AS (SELECT *, len(units) AS n, ('0x' || hash[1:8])::BIGINT AS h1, ('0x' || hash[9:16])::BIGINT AS h2, ('0x' || hash[17:24])::BIGINT AS h3, ('0x' || hash[25:32])::BIGINT AS h4 FROM t),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
parts AS (SELECT *, coalesce(list_aggregate(units[1:a], 'string_agg', ''), '') AS p, coalesce(list_aggregate(units[a + 1:b], 'string_agg', ''), '') AS m,
  coalesce(list_aggregate(units[b + 1:], 'string_agg', ''), '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


def _cluster_sql(rounds: int = 5) -> str:
    near = """
d{r} AS MATERIALIZED (SELECT vec_id, cluster, sum((x.q - c.q) * (x.q - c.q))::BIGINT AS distance FROM x JOIN c{r} c USING (i) GROUP BY ALL),
n{r} AS MATERIALIZED (SELECT DISTINCT ON (vec_id) vec_id, cluster, distance FROM d{r} ORDER BY vec_id, distance, cluster)"""
    step = """,
c{s} AS MATERIALIZED (SELECT c.cluster, c.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.q)::BIGINT AS q FROM c{r} c LEFT JOIN
  (SELECT cluster, i, sum(q) AS s, count(*) AS n FROM x JOIN n{r} USING (vec_id) GROUP BY ALL) m USING (cluster, i)),"""
    steps = "".join(near.format(r=r) + (step.format(r=r, s=r + 1) if r < rounds else "") for r in range(rounds + 1))
    return f"""
WITH kept AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding::DOUBLE[], lambda e: e IS NOT NULL AND isfinite(e))) = 64),
x AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS i, floor(256 * unnest(v))::BIGINT AS q FROM kept),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster FROM kept QUALIFY cluster < 40),
c0 AS MATERIALIZED (SELECT cluster, i, q FROM first JOIN x USING (vec_id)),{steps},
name AS (SELECT cluster, sha256(string_agg(q::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM n{rounds} JOIN name USING (cluster)
"""


ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": _EXACT_SQL,
    "op10_line_dedup": _LINE_SQL,
    "op11_fill_middle": _MIDDLE_SQL,
    "op12_centroid_clustering": _cluster_sql(),
}
