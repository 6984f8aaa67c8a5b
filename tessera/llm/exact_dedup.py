"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of ``BLOCK`` bytes. Distinct blocks are sorted into integer names; then
adjacent names are paired and the distinct pairs are named again, until one name is left for each document.
Together with the length that name is the document's identity: equal names mean equal bytes, at every level.

Blocks are shuffled once, after a map-side combine. Rows find the name of their block by two 64-bit digests
rather than by the block; a digest that two different blocks share is found while naming, and then the blocks
themselves are compared instead, so digests never decide an equality. Each level is written to the shared
folder before it is used: names are assigned once.

Null text is empty. Every input row counts as a document of its own; rows that repeat a doc_id are ordered by
their place in the table, and a null doc_id sorts last. An empty table gives an empty result. Only the columns
doc_id and text are looked at, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import SPACE_CLASS, numbered, row_id
from tessera.session import materialize

#: Bytes in a block.
BLOCK = 1024

Digest = Callable[[F.Column], tuple[F.Column, F.Column]]


def digests(block: F.Column) -> tuple[F.Column, F.Column]:
    return F.xxhash64(block), F.xxhash64(F.lit(7), block)


def normalised(text: F.Column) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", " ")


def _blocks(docs: DataFrame, block: int, rid: str | None) -> DataFrame:
    """rid, doc_id, n_bytes, sha, pos, block: at least one block for every row."""
    body = docs.select(row_id(rid), "doc_id", normalised(F.col("text")).cast("binary").alias("body"))
    cut = F.transform(
        F.expr(f"sequence(0, cast(greatest(0, octet_length(body) - 1) div {block} as int))"),
        lambda i: F.substring(F.col("body"), i * block + F.lit(1), F.lit(block)),
    )
    return body.select("rid", "doc_id", F.octet_length("body").alias("n_bytes"), F.sha2("body", 256).alias("sha"), F.posexplode(cut).alias("pos", "block"))


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Sort the distinct rows of each hash partition by ``by`` and number them."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def name_blocks(docs: DataFrame, block: int = BLOCK, digest: Digest = digests, rid: str | None = None) -> DataFrame:
    """rid, doc_id, n_bytes, sha, pos, name for every block of every row."""
    cut = _blocks(docs, block, rid)
    a, b = digest(F.col("block"))
    rows = materialize(cut.select("rid", "doc_id", "n_bytes", F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), "pos", a.alias("a"), b.alias("b")), "block-digests")
    distinct = cut.select(a.alias("a"), b.alias("b"), "block").groupBy("a", "b", "block").agg(F.lit(0).alias("one"))
    names = materialize(_named(distinct, ["a", "b", "block"]).select("a", "b", "name"), "block-names")
    shared = names.groupBy("a", "b").count().where("count > 1")
    if shared.isEmpty():
        return rows.join(names, ["a", "b"]).drop("a", "b")
    whole = materialize(_named(distinct, ["a", "b", "block"]).select("block", "name"), "block-names-whole")
    first = F.when(F.col("pos") == 0, F.col("sha")).alias("sha")
    return cut.join(whole, "block").select("rid", "doc_id", "n_bytes", first, "pos", "name")


def identities(docs: DataFrame, block: int = BLOCK, digest: Digest = digests, rid: str | None = None) -> DataFrame:
    """rid, doc_id, n_bytes, sha, name: one row for each row of ``docs``; (n_bytes, name) is its identity."""
    level = materialize(name_blocks(docs, block, digest, rid), "names-0")
    heads = level.where("pos = 0").select("rid", "doc_id", "n_bytes", "sha")
    done = level.where(F.col("n_bytes") <= block).select("rid", "name")
    size, k = block, 0
    rest = level.where(F.col("n_bytes") > block).select("rid", "n_bytes", "pos", "name")
    while not rest.isEmpty():
        k, size = k + 1, size * 2
        pairs = materialize(
            rest.groupBy("rid", "n_bytes", F.expr("pos div 2").alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r")
            ),
            f"pairs-{k}",
        )
        names = materialize(_named(pairs.select("l", "r").distinct(), ["l", "r"]), f"pair-names-{k}")
        level = materialize(pairs.join(names, ["l", "r"]).select("rid", "n_bytes", "pos", "name"), f"names-{k}")
        done = done.unionByName(level.where(F.col("n_bytes") <= size).select("rid", "name"))
        rest = level.where(F.col("n_bytes") > size)
    return heads.join(done, "rid")


def exact_groups(docs: DataFrame, block: int = BLOCK, digest: Digest = digests, rid: str | None = None) -> DataFrame:
    """rid, doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``; ``rid`` names a column of numbers that it has."""
    ids = materialize(identities(docs, block, digest, rid), "identities")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rid").alias("rid"))
    groups = ids.groupBy("n_bytes", "name").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    several = materialize(groups.where("group_size > 1"), "identity-groups")
    alone = F.col("group_size").isNull()
    return ids.join(several, ["n_bytes", "name"], "left").select(
        "rid",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("rid") == F.col("first.rid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The first row of each group of equal texts, with all columns of ``docs``.

    Rows are numbered in a written table. Only the numbers of the rows to drop are compared with the texts.
    """
    own = docs.columns
    rows = numbered(docs, F.struct(*own).alias("row"))
    gone = exact_groups(rows.select("rid", "row.doc_id", "row.text"), block, rid="rid").where("not kept").select("rid")
    return rows.join(gone, "rid", "left_anti").select(*(F.col("row")[c].alias(c) for c in own))
