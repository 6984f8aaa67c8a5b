"""The test tables as files, relations, logs and jobs: plain projections, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("long").alias("size"), F.col("lang").alias("language"), F.col("source").alias("project_id"), "doc_id",
    )


def previous_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = files(spark, sf_dir).where("doc_id % 10 <> 0")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    return now.withColumn("content", text).withColumn("sha256", F.sha2("content", 256)).withColumn("size", F.octet_length("content").cast("long"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    o = read(spark, sf_dir, "orders").join(F.broadcast(n), F.lit(True))
    node = lambda c: F.concat(F.lit("n"), c.cast("string"))
    target = F.pmod(F.col("o_orderkey") * 7919, F.col("n"))
    return o.select(
        F.col("o_orderkey").alias("fact_order"), node(F.col("o_custkey")).alias("source_symbol_id"), node(target).alias("target_symbol_id"),
        node(F.floor(F.col("o_custkey") / 4)).alias("source_path"), node(F.floor(target / 4)).alias("target_path"),
        F.when(F.col("o_orderstatus") == "F", "CALL").otherwise("IMPORT").alias("kind"), F.col("o_orderkey").alias("line"), F.lit("resolved").alias("resolution"),
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("name"), F.lit("e").alias("evidence"), (F.col("o_orderkey") % 5 == 0).alias("type_only"),
        F.lit("body").alias("execution_context"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(spark, sf_dir).select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("tgt")).distinct()


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of the graph queries: every hundredth node."""
    return read(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("node"))


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python module for each node of the graph: it imports the modules of its targets and calls into them."""
    pairs = relations(spark, sf_dir).select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("tgt"))
    ends = F.array(F.struct("src", "tgt"), F.struct(F.col("tgt").alias("src"), F.lit(None).cast("string").alias("tgt")))
    # A stated number of parts stays as it is, however small their bytes: parsing takes its time by the file.
    dealt = pairs.select(F.explode(ends).alias("e")).select("e.*").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "src")
    rows = dealt.groupBy("src").agg(F.array_sort(F.collect_set("tgt")).alias("targets"))
    others = F.filter("targets", lambda t: t != F.col("src"))
    imports = F.array_join(F.transform(others, lambda t: F.concat(F.lit("from pkg."), t, F.lit(" import f_"), t, F.lit("\n"))), "")
    calls = F.array_join(F.transform("targets", lambda t: F.concat(F.lit("    x = f_"), t, F.lit("(x)\n"))), "")
    content = F.concat(imports, F.lit("\n\ndef f_"), F.col("src"), F.lit("(x):\n"), calls, F.lit("    return x\n"))
    return rows.select(F.concat(F.lit("src/pkg/"), F.col("src"), F.lit(".py")).alias("path"), content.alias("content"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("job_id"), F.col("turn").cast("long").alias("seq"), F.col("text").cast("binary").alias("data"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("state"), F.col("ts").alias("updated"), F.col("event_id").alias("seq"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(
        F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualname"),
        F.when(F.col("p_partkey") % 3 == 0, "class").when(F.col("p_partkey") % 3 == 1, "function").otherwise("module").alias("kind"),
        F.col("p_size").cast("long").alias("start_line"), F.col("p_type").alias("language"), F.concat(F.lit("sym_"), F.col("p_partkey").cast("string")).alias("symbol_id"),
    )
