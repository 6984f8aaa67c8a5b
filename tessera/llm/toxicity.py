"""Toxicity by a support vector machine with a subsequence string kernel and Nystroem landmarks.

The kernel counts common subsequences of ``ORDER`` characters, each weighted by ``DECAY`` to the length it
spans, so a gap or an inserted character lowers a match but does not lose it. Words carry marks at both ends. A
sentence is a bag of its words and as toxic as its worst word, a document as its worst sentence.

Training takes a bounded sample of labelled documents. Words that toxic sentences hold far more often than
clean ones are witnesses; they, copies of them with an inserted character, and words of clean sentences are
mapped to Nystroem features over landmarks, a linear SVM is fitted there, the clean words it likes best are
added, and it is fitted again. Since the kernel is an inner product over subsequences, the fitted machine folds
into one weight for each subsequence, and a word costs the same whatever the number of landmarks. A logistic
curve, fitted on the sample's documents, maps the margins of a document's worst two words to its score.

At most ``MAX_LABELLED`` labelled documents are used, chosen by hash. Null and empty texts hold no word and get
the score of the lowest margin. Without usable labels every score is the share of toxic labels. Repeated rows
are scored one by one; extra columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.sampling import labelled_texts
from tessera.session import materialize

MAX_LABELLED = 8_000
ORDER, DECAY = 3, 0.6
ALPHABET = 64
#: A longer word is scored by overlapping pieces of this length.
PIECE = 20
WITNESSES, LANDMARKS, CLEAN = 160, 256, 6_000
#: Words whose margin a Python worker remembers.
REMEMBERED = 400_000
FLOOR = -3.0

_EDGE = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?:(?<=\s)|^)\w(?:[\s.\-_*]+\w){3,}(?=\s|[.,!?;:]|$)")
_SENTENCE = re.compile(r"[.!?\n]+")


def sentence_words(text: str) -> set[str]:
    """The words of one sentence or text: trimmed of marks, also without inner marks, letters set apart joined."""
    lowered = text.lower()
    words = set(lowered.split())
    for found in _SPACED.findall(lowered):
        words.add(_INNER.sub("", found))
    out = set()
    for w in words:
        if w.isalnum():
            out.add(w)
            continue
        w = _EDGE.sub("", w)
        if len(w) > 1:
            out.add(w)
            bare = _INNER.sub("", w)
            if bare != w and len(bare) > 2:
                out.add(bare)
    return out


@lru_cache(maxsize=64)
def _spans(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a word of ``n`` characters, and the weight of each."""
    at = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
    return at, (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)


@dataclass(frozen=True)
class Alphabet:
    codes: dict[str, int]

    @staticmethod
    def of(words: list[str]) -> Alphabet:
        """The most frequent characters get a code of their own; 0 marks a word's ends, 1 is any other."""
        counts: dict[str, int] = {}
        for w in words:
            for c in w:
                counts[c] = counts.get(c, 0) + 1
        common = sorted(counts, key=lambda c: (-counts[c], c))[: ALPHABET - 2]
        return Alphabet({c: k + 2 for k, c in enumerate(common)})

    def encode(self, word: str) -> list[int]:
        return [0, *(self.codes.get(c, 1) for c in word), 0]


def subsequences(coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length (rows of codes): the number of each subsequence, and its weight."""
    at, weight = _spans(coded.shape[1])
    number = np.zeros((len(coded), len(at)), np.int64)
    for k in range(ORDER):
        number = number * ALPHABET + coded[:, at[:, k]]
    return number, weight


def _self_norms(number: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square roots of the kernel of each word with itself: equal subsequences add up before squaring."""
    order = np.argsort(number, axis=1, kind="stable")
    n, w = np.take_along_axis(number, order, 1), weight[order]
    new = np.ones(n.shape, bool)
    new[:, 1:] = n[:, 1:] != n[:, :-1]
    flat = np.add.reduceat(w.ravel(), np.flatnonzero(new.ravel()))
    owner = np.repeat(np.arange(len(n)), new.sum(1))
    return np.sqrt(np.bincount(owner, flat.astype(np.float64) ** 2, len(n)))


def pieces(word: str) -> list[str]:
    if len(word) <= PIECE:
        return [word]
    return [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


def inner_products(words: list[str], alphabet: Alphabet, tables: list[np.ndarray]) -> np.ndarray:
    """The normalised feature vector of each word times each table, words of equal length together."""
    out = np.zeros((len(words), len(tables)))
    coded = [alphabet.encode(w) for w in words]
    lengths = np.array([len(c) for c in coded])
    for n in np.unique(lengths[lengths >= ORDER]):
        rows = np.flatnonzero(lengths == n)
        block = max(1, 2_000_000 // len(_spans(int(n))[0]))
        for lo in range(0, len(rows), block):
            part = rows[lo : lo + block]
            number, weight = subsequences(np.array([coded[i] for i in part], np.int64))
            norm = _self_norms(number, weight)
            for k, table in enumerate(tables):
                out[part, k] = (table[number] * weight).sum(1) / norm
    return out


def feature_table(word: str, alphabet: Alphabet) -> np.ndarray:
    """The normalised feature vector of one word as a dense table."""
    number, weight = subsequences(np.array([alphabet.encode(word)], np.int64))
    table = np.bincount(number[0], weight, ALPHABET**ORDER)
    return (table / np.linalg.norm(table)).astype(np.float32)


def kernel(a: str, b: str, alphabet: Alphabet) -> float:
    """The normalised kernel of two words of at most PIECE characters."""
    return float(inner_products([a], alphabet, [feature_table(b, alphabet)])[0, 0])


@dataclass
class ToxicityModel:
    alphabet: Alphabet
    table: np.ndarray
    bias: float
    curve: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def margins(self, words: list[str]) -> np.ndarray:
        cut = [pieces(w) for w in words]
        flat = [p for parts in cut for p in parts]
        got = inner_products(flat, self.alphabet, [self.table])[:, 0] + self.bias if flat else np.zeros(0)
        starts = np.cumsum([0, *(len(p) for p in cut[:-1])]) if cut else np.zeros(0, np.int64)
        return np.maximum.reduceat(got, starts) if flat else got


class Scorer:
    """Margins of texts, with a bounded memory of words."""

    def __init__(self, model: ToxicityModel, remembered: int = REMEMBERED) -> None:
        self.model, self.remembered, self.known = model, remembered, {}

    def margins(self, texts: list[str | None]) -> list[tuple[float, float]]:
        """The margins of each text's worst two words."""
        bags = [sentence_words(t or "") for t in texts]
        missing = sorted(set().union(*bags) - self.known.keys()) if bags else []
        if len(self.known) + len(missing) > self.remembered:
            self.known.clear()
            missing = sorted(set().union(*bags))
        self.known.update(zip(missing, self.model.margins(missing).tolist(), strict=True))
        return [(*sorted(map(self.known.__getitem__, bag), reverse=True)[:2], FLOOR, FLOOR)[:2] for bag in bags]


_scorers: dict[str, Scorer] = {}


def _train_machine(words: list[str], y: np.ndarray, weight: np.ndarray, landmarks: list[str], alphabet: Alphabet, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """A squared-hinge linear SVM on Nystroem features; returned as one table over subsequences and a bias."""
    tables = [feature_table(w, alphabet) for w in landmarks]
    k = inner_products(words, alphabet, tables)
    values, vectors = np.linalg.eigh(np.array([[float(a @ b) for b in tables] for a in tables]))
    root = vectors / np.sqrt(np.maximum(values, 1e-4)) @ vectors.T
    x = np.hstack([k @ root, np.ones((len(words), 1))])
    w = v = np.zeros(x.shape[1])
    step = 1.0 / (2.0 * float(np.linalg.norm(x * np.sqrt(weight)[:, None], 2)) ** 2 / weight.sum() + ridge)
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(0.0, 1.0 - y * (x @ v))
        new = v - step * (-2.0 * (x.T @ (weight * y * slack)) / weight.sum() + ridge * np.r_[v[:-1], 0.0])
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (before - 1) / t * (new - w)
        w = new
    alpha = root @ w[:-1]
    return sum(a * b for a, b in zip(alpha.astype(np.float32), tables, strict=True)), float(w[-1])


def _inserted(word: str, k: int) -> str:
    """A copy of the word with one character set in, at a place that follows from ``k``."""
    at = 1 + k % max(1, len(word) - 1)
    return word[:at] + ".x-*1"[k % 5] + word[at:]


def sentence_table(sample: DataFrame) -> DataFrame:
    """word, toxic, clean: the number of labelled sentences' documents that hold each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, y = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = set()
                for sentence in _SENTENCE.split(text or ""):
                    held |= sentence_words(sentence)
                words += sorted(p for w in held for p in pieces(w) if len(p) > 2)
                y += [label] * (len(words) - len(y))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(y, pa.int32())], ["word", "y"])

    rows = sample.mapInArrow(run, "word string, y int")
    return rows.groupBy("word").agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("clean"))


def document_margins(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``margin`` and ``second``, the margins of the worst two words, of every row."""
    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = docs.select(*keep).schema.add("margin", "double").add("second", "double")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = f"{id(sent)}-{float(np.abs(model.table).sum())}-{model.bias}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm import toxicity

        if name not in toxicity._scorers:
            toxicity._scorers.clear()
            toxicity._scorers[name] = Scorer(sent.value)
        scorer = toxicity._scorers[name]
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            found = [m for lo in range(0, len(texts), 500) for m in scorer.margins(texts[lo : lo + 500])]
            pairs = np.array(found, np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema.names)

    return rows.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_LABELLED) -> ToxicityModel | float:
    """The fitted model, or the share of toxic labels if the sample gives no witness."""
    sample = materialize(labelled_texts(docs, labels, label, most), "toxicity-sample")
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values())) if n else 0.5
    if not n.get(1) or not n.get(0):
        return share
    table = materialize(sentence_table(sample), "toxicity-words")
    rate = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    gain = F.col("toxic") * F.log(rate / share) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    ranked = table.where("toxic >= 3").where(rate > 2 * share / (1 + share)).withColumn("gain", gain)
    top = ranked.orderBy(F.desc("gain"), "word").limit(WITNESSES).toPandas()
    top = top[top["gain"] >= math.log(max(2, table.count()))]
    if not len(top):
        return share
    toxic = top["word"].tolist()
    clean_words = table.where("clean > 0 and toxic <= clean")
    clean = [r[0] for r in clean_words.orderBy(F.xxhash64("word"), "word").limit(CLEAN).select("word").collect()]
    alphabet = Alphabet.of(toxic + clean)
    variants = [_inserted(w, k) for k, w in enumerate(toxic) if len(w) > 4]
    landmarks = toxic + clean[: LANDMARKS - len(toxic)]
    support = np.log1p(top["toxic"].to_numpy(float))
    for turn in range(3):
        words = toxic + variants + clean
        y = np.r_[np.ones(len(toxic) + len(variants)), -np.ones(len(clean))]
        weight = np.r_[support, np.full(len(variants), 0.3 * support.mean()), np.ones(len(clean))]
        weight[y < 0] *= 2.0 * weight[y > 0].sum() / len(clean)
        model = ToxicityModel(alphabet, *_train_machine(words, y, weight, landmarks, alphabet))
        if turn == 2:
            break
        liked = word_margins(clean_words.select("word"), model).orderBy(F.desc("margin"), "word").limit(1_500).collect()
        hard = sorted({r["word"] for r in liked} - set(clean))
        clean = clean + hard
        landmarks = toxic + [r["word"] for r in liked[: LANDMARKS - len(toxic)]]
    found = document_margins(sample, model, ["y"]).toPandas()
    model.curve = _curve(found[["margin", "second"]].to_numpy(float), found["y"].to_numpy(float))
    return model


def word_margins(words: DataFrame, model: ToxicityModel) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield df.assign(margin=model.margins(df["word"].tolist()))

    return words.mapInPandas(run, "word string, margin double")


def _curve(margins: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """Slopes of the two margins and an offset of the logistic curve, by Newton steps with a little ridge."""
    x = np.hstack([margins, np.ones((len(margins), 1))])
    w = np.array([1.0, 0.0, 0.0])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(3) * len(y) ** 0.5, x.T @ (p - y) + 1e-3 * w)
    return tuple(max(0.0, float(v)) if k < 2 else float(v) for k, v in enumerate(w))


def score(docs: DataFrame, model: ToxicityModel | float, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every row."""
    if isinstance(model, float):
        scored = docs.select("doc_id", F.lit(model).alias("score"))
    else:
        a, b, c = map(F.lit, model.curve)
        curve = 1.0 / (1.0 + F.exp(-(a * F.col("margin") + b * F.col("second") + c)))
        scored = document_margins(docs, model, ["doc_id"]).select("doc_id", curve.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_LABELLED) -> DataFrame:
    return score(docs, train(docs, labels, label, most))
