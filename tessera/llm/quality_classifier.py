"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees of small depth are fitted to a bounded sample of labelled documents. Every path from a root to a
node is a rule, a conjunction of thresholds on statistics. A lasso-penalised logistic regression then gives a
weight to few of the rules, and the surviving rules are compiled into one Spark column expression, so scoring
is a projection over the statistics of each document.

At most ``MAX_LABELLED`` labelled rows are used, chosen by hash. Null and empty texts have all statistics zero
and are scored like any other. With fewer than ``LEAST`` labelled rows, or with labels of one kind only, no rules are
fitted and every score is the share of ones among them, kept off 0 and 1 (0.5 without any). Repeated rows are scored one by one; extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.sampling import labelled_texts
from tessera.llm.textstats import BASE, EXTRA, full_stats

MAX_LABELLED = 12_000
#: Labelled rows that rules are fitted to at least.
LEAST = 40
TREES, DEPTH, CUTS, SHRINK = 16, 3, 24, 0.4
PENALTY = 0.002

#: Statistics as (numerator, denominator or None).
FEATURES = {
    "words": ("n_words", None),
    "mean_word": ("word_chars", "n_words"),
    "longest_word": ("longest_word", None),
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "distinct": ("n_distinct", "n_words"),
    "digits": ("n_digits", "n_bytes"),
    "capitals": ("n_upper", "n_bytes"),
    "punctuation": ("n_punct", "n_words"),
    "stutter": ("n_stutter", "n_words"),
    "short_words": ("n_short", "n_words"),
    "words_in_line": ("n_words", "n_lines"),
}

Condition = tuple[str, bool, float]


def features() -> dict[str, Column]:
    ratio = lambda a, b: F.col(a).cast("double") if b is None else F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))
    return {k: ratio(a, b) for k, (a, b) in FEATURES.items()}


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and all statistics of each text."""
    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = docs.select(*keep).schema
    for name in (*BASE, *EXTRA):
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [full_stats(t) for t in batch.column(len(keep)).to_pylist()]
            columns = np.array(found, np.int64).reshape(len(found), len(BASE) + len(EXTRA)).T
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, columns)], schema.names)

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class RuleEnsemble:
    """Intercept and weighted rules; a rule is a conjunction of (feature, above, threshold)."""

    intercept: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...]

    def score(self) -> Column:
        """The probability of label 1 as a column over ``features()``."""
        values = features()
        total = F.lit(self.intercept)
        for weight, conditions in self.rules:
            holds = F.lit(True)
            for name, above, at in conditions:
                holds &= (values[name] > at) if above else (values[name] <= at)
            total += F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _tree(codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: tuple, depth: int, out: list) -> None:
    """Grow one tree on binned features; ``out`` gets (path, rows, value) of every node below the root."""
    if path:
        out.append((path, rows, -grad[rows].sum() / (hess[rows].sum() + 1.0), depth == 0))
    if depth == 0 or len(rows) < 20:
        return
    best = (1e-6, None, None)
    g, h = grad[rows].sum(), hess[rows].sum()
    for f in range(codes.shape[1]):
        c = codes[rows, f]
        gl = np.cumsum(np.bincount(c, grad[rows], CUTS + 1))[:-1]
        hl = np.cumsum(np.bincount(c, hess[rows], CUTS + 1))[:-1]
        gain = gl**2 / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0) - g**2 / (h + 1.0)
        gain[(hl < 0.5) | (h - hl < 0.5)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    _, f, k = best
    if f is None:
        return
    left = codes[rows, f] <= k
    _tree(codes, grad, hess, rows[left], (*path, (f, False, k)), depth - 1, out)
    _tree(codes, grad, hess, rows[~left], (*path, (f, True, k)), depth - 1, out)


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal steps; the intercept is free."""
    n, m = x.shape
    full = np.hstack([np.ones((n, 1)), x])
    step = 4.0 / max(1e-9, float(np.linalg.norm(full, 2)) ** 2 / n)
    w = v = np.zeros(m + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(full @ v, -30, 30)))
        new = v - step * (full.T @ (p - y) / n)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (before - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> RuleEnsemble:
    """Fit the ensemble to a matrix with the columns of ``FEATURES`` and labels 0 or 1."""
    ones = float(y.mean()) if len(y) else 0.5
    if len(y) < LEAST or ones in (0.0, 1.0):
        ones = min(max(ones, 1e-3), 1 - 1e-3)
        return RuleEnsemble(math.log(ones / (1 - ones)), ())
    names = list(FEATURES)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin, everything = np.full(len(y), math.log(ones / (1 - ones))), np.arange(len(y))
    rules: dict[tuple, np.ndarray] = {}
    for _ in range(TREES):
        p = 1.0 / (1.0 + np.exp(-margin))
        nodes: list = []
        _tree(codes, p - y, p * (1 - p), everything, (), DEPTH, nodes)
        paths = {path for path, *_ in nodes}
        for path, rows, value, _ in nodes:
            if not any(other[: len(path)] == path and other != path for other in paths):
                margin[rows] += SHRINK * value
            key = tuple(sorted(path))
            if key not in rules:
                rules[key] = np.zeros(len(y))
                rules[key][rows] = 1.0
    keys = [k for k, v in rules.items() if 0.002 < v.mean() < 0.998]
    if not keys:
        return RuleEnsemble(math.log(ones / (1 - ones)), ())
    intercept, weights = _lasso(np.stack([rules[k] for k in keys], axis=1), y.astype(float), penalty)
    made = tuple((float(w), tuple((names[f], above, float(edges[f][k])) for f, above, k in key)) for w, key in zip(weights, keys, strict=True) if abs(w) > 1e-4)
    return RuleEnsemble(intercept, made)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> RuleEnsemble:
    sample = with_statistics(labelled_texts(docs, labels, label, most), ["y"])
    rows = sample.select("y", *(v.alias(k) for k, v in features().items())).toPandas()
    order = np.lexsort(rows.to_numpy(float).T)
    rows = rows.iloc[order]
    return fit_rules(rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float))


def score(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted of every row."""
    scored = with_statistics(docs, ["doc_id"]).select("doc_id", model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> DataFrame:
    return score(docs, train(docs, labels, label, most))
