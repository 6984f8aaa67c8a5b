"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Each document gets counts (``textstats``); four ratios of them are sketched per (lang, source) as logarithmic
histograms: a bucket holds the values within a fixed relative error of each other, so a sketch is a set of
(bucket, count) rows and two sketches merge by adding counts. Sketches are built by one partial aggregation,
which reduces a source of any size to a bounded number of rows before the shuffle, and the result is the same
for every partitioning. A group that is too small borrows the merged sketch of its language, then that of the
whole corpus. The fences replace fixed cut-offs; documents are then filtered by a join with the fences.

Null text counts as empty; null lang or source is a group of its own; an empty table gives an empty result;
repeated rows are judged one by one. Clashing column names cannot occur: work happens on renamed columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.textstats import BASE, base_stats
from tessera.session import materialize, maybe_broadcast

#: Relative width of a sketch bucket.
ALPHA = 0.02
#: Ratios are shifted by this before the logarithm, so zero has a bucket.
SHIFT = 0.01
#: ratio -> (smallest spread that counts, spreads allowed below the median or None, spreads allowed above). Where a
#: group hardly varies, the smallest spread decides: a fifth of repeated words is then too many, and the base rule, at
#: 30 %, is left to groups that repeat more themselves.
RULES = {
    "mean_word": (0.5, 5.0, 5.0),
    "symbol_ratio": (0.03, None, 5.0),
    "dup_line_ratio": (0.06, None, 5.0),
    "repeat_ratio": (0.04, None, 5.0),
}
#: A group with fewer documents uses a wider group's sketch.
MIN_GROUP = 200
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def with_stats(docs: DataFrame, keep: list[str], text: str = "text", inside: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` plus the counts of ``textstats.BASE`` and ``n_lines``.

    ``inside`` names a struct column among ``keep`` that holds the text, which then travels only once.
    """
    names = (*BASE, "n_lines")
    kept = docs.select(*keep) if inside else docs.select(F.col(text).alias("_text"), *keep)
    schema = docs.select(*keep).schema
    for name in names:
        schema = schema.add(name, "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(keep.index(inside)).field(text) if inside else batch.column(0)
            found = [base_stats(t) + ((t or "").count("\n") + 1,) for t in texts.to_pylist()]
            rows = np.array(found, np.int64).reshape(len(found), len(names))
            own = batch.columns if inside else batch.columns[1:]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, rows.T)], [*keep, *names])

    return kept.mapInArrow(count, schema)


def ratios() -> dict[str, F.Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / n,
    }


def sketches(stats: DataFrame, group: list[str]) -> DataFrame:
    """(group..., stat, bucket, n): one mergeable sketch per group and ratio."""
    gamma = float(np.log1p(ALPHA))
    cells = F.array(
        *(F.struct(F.lit(k).alias("stat"), F.ceil(F.log(v + F.lit(SHIFT)) / F.lit(gamma)).cast("int").alias("bucket")) for k, v in ratios().items())
    )
    return stats.select(*group, F.explode(cells).alias("c")).groupBy(*group, "c.stat", "c.bucket").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, group: list[str]) -> DataFrame:
    """The sketches of wider groups: counts of equal buckets add up."""
    return sketch.groupBy(*group, "stat", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, group: list[str], probs: dict[str, float]) -> DataFrame:
    """(group..., stat, total, one column per quantile): the value of the bucket in which the rank falls."""
    by = [*group, "stat"]
    seen = sketch.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("bucket"))).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    middle = 2.0 / (2.0 + ALPHA)
    value = F.pow(F.lit(1.0 + ALPHA), F.col("bucket")) * F.lit(middle) - F.lit(SHIFT)
    return seen.groupBy(*by).agg(
        F.max("total").alias("total"),
        *(F.greatest(F.lit(0.0), F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("total")), value))).alias(k) for k, p in probs.items()),
    )


def fences(stats: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source) with a lower and an upper fence for each ratio.

    Documents that fail the base rules are left out of the sketches: they are rejected in any case.
    """
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    good = stats.where(~F.col("base_failed"))
    own = materialize(sketches(good, ["lang", "source"]), "rule-sketches")
    by_lang = merge(own, ["lang"])
    wide = quantiles(merge(own, []), [], probs)
    mid = quantiles(by_lang, ["lang"], probs)
    narrow = quantiles(own, ["lang", "source"], probs)

    def named(df: DataFrame, tag: str, by: list[str]) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{tag}_{c}") for c in by), "stat", *(F.col(c).alias(f"{tag}_{c}") for c in ("total", *probs)))

    m, w = named(mid, "m", ["lang"]), named(wide, "w", [])
    joined = narrow.join(m, (narrow["lang"].eqNullSafe(m["m_lang"])) & (narrow["stat"] == m["stat"]), "left").drop(m["stat"]).join(w, "stat", "left")
    pick = lambda c: F.when(F.col("total") >= min_group, F.col(c)).when(F.col("m_total") >= min_group, F.col(f"m_{c}")).otherwise(F.col(f"w_{c}"))
    flat = joined.select("lang", "source", "stat", *(pick(c).alias(c) for c in probs))
    out = []
    for name, (least, below, above) in RULES.items():
        here = F.col("stat") == name
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        out.append(F.max(F.when(here, F.col("q2") + above * spread)).alias(f"{name}_hi"))
        if below is not None:
            out.append(F.max(F.when(here, F.col("q2") - below * spread)).alias(f"{name}_lo"))
    return flat.groupBy("lang", "source").agg(*out)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def within(prefix: str = "") -> F.Column:
    """The verdict of the fences; a row without fences (no good document in its group) passes."""
    ok = F.lit(True)
    for name, value in ratios().items():
        ok &= value <= F.coalesce(F.col(f"{name}_hi"), F.lit(float("inf")))
        if RULES[name][1] is not None:
            ok &= value >= F.coalesce(F.col(f"{name}_lo"), F.lit(float("-inf")))
    return ok


def judge(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """``stats`` with ``kept``; ``limits`` is broadcast only while its counted rows stay small."""
    limits = materialize(limits, "rule-fences")
    named = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    side = maybe_broadcast(named, limits.count())
    joined = stats.join(side, stats["lang"].eqNullSafe(side["_lang"]) & stats["source"].eqNullSafe(side["_source"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & within()).drop("_lang", "_source", *(c for c in limits.columns if c not in ("lang", "source")))


def apply_rules(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept for every row of ``docs``."""
    stats = materialize(with_stats(docs, ["doc_id", "lang", "source"]).withColumn("base_failed", base_failed()), "rule-stats")
    return judge(stats, fences(stats, min_group))


def filter_documents(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Counts are made twice, first for the fences and then beside the texts, which is cheaper than moving texts
    through a shuffle; the second pass needs only the fences.
    """
    stats = with_stats(docs, ["lang", "source"]).withColumn("base_failed", base_failed())
    limits = fences(materialize(stats, "rule-stats"), min_group)
    own = docs.columns
    packed = docs.select(F.struct(*own).alias("row"), F.col("lang").alias("lang"), F.col("source").alias("source"))
    counted = with_stats(packed, ["row", "lang", "source"], inside="row").withColumn("base_failed", base_failed())
    return judge(counted, limits).where("kept").select(*(F.col("row")[c].alias(c) for c in own))
