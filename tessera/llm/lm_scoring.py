"""Language-model scores of whole documents from a gated recurrent model.

Token counts come from all training documents by one aggregation. The most frequent tokens are the network's own,
``side * side`` of them with a side that grows with the vocabulary; the others share one token, whose probability
the counts of these other tokens divide among them, so every text has a proper probability. The network is trained
by rounds of parameter averaging. Every training document takes part in one round: it goes to one replica by hash,
which runs truncated backpropagation over its documents, and the parameters of a round's replicas are averaged
level by level, so no average has more than ``FAN`` parts.

Scoring needs the count of every token. The ``HEAD`` most frequent ones, a bounded number, are sent to the tasks,
which write each row's ids and sums once; ties at the head's end are broken by a hash of the token. All other
tokens meet the count table in a join on the token, aggregated by document. No word outside the head is frequent,
so that join has no hot key.

Null text counts as empty and has the end token alone. A null doc_id counts as the empty text in the hash that
holds documents out. Rows that repeat a doc_id are scored one by one. An empty table gives an empty result, and
without training documents all counts are zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tessera.llm import gru
from tessera.llm.hashing import held_out, row_id
from tessera.session import materialize

MOD, REMAINDER = 7, 2
#: The end of a text as a token: no word is empty.
END_TOKEN = ""
#: Classes, and members of each: at least LEAST_SIDE, else twice the fifth root of the number of distinct tokens.
LEAST_SIDE, HIDDEN, EMBED = 16, 24, 16
HEAD = 100_000
#: Tokens of a replica; there are as many replicas as the training tokens need. A task holds about 20 bytes for each.
REPLICA_TOKENS, ROUNDS = 4_000_000, 2
#: Most averages that meet on the driver, and most that one average has as its parts.
AVERAGES, FAN = 16, 32
#: Bytes of text that a task splits into words at once.
PIECE_BYTES = 8 << 20
#: Tokens that a task scores at once.
CHUNK = 4_000_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def words_of(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """(first, end, words, owner) of pieces of at most ``PIECE_BYTES`` of texts, or of one: the ``tokens`` of rows first to
    end without their end tokens, and for each word the place of its row in the piece."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = upto[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(upto, before + PIECE_BYTES, "right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(first, end - first), "")))
        sizes = np.diff(lists.offsets.to_numpy())
        words, owner = lists.flatten(), np.repeat(np.arange(end - first), sizes)
        # White space at an end of a text leaves an empty word there.
        some = pc.greater(pc.binary_length(words), 0)
        yield first, end, words.filter(some).cast(pa.binary()), owner[some.to_numpy(zero_copy_only=False)]
        first = end


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, c over the rows of ``docs``; counted within each batch before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, words, _ in words_of(batch.column(0)):
                found = words.value_counts()
                token = pa.concat_arrays([found.field("values"), pa.array([END_TOKEN.encode()], pa.binary())])
                yield pa.RecordBatch.from_arrays([token, pa.concat_arrays([found.field("counts"), pa.array([end - first], pa.int64())])], ["token", "c"])

    return docs.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Totals over the training tokens, and the most frequent ones (``head``, without the end token) in order."""

    total: int
    distinct: int
    end: int
    head: dict[bytes, int]
    side: int = 0

    def __post_init__(self) -> None:
        self.side = self.side or max(LEAST_SIDE, round(2 * self.distinct**0.2))
        self.own_counts = np.fromiter(self.head.values(), np.float64, len(self.head))[: self.side**2 - 2]
        self.rest_total = self.total - self.end - int(self.own_counts.sum())
        rest_distinct = self.distinct - (self.end > 0) - len(self.own_counts)
        self.base_log = math.log10(self.total + self.distinct + 1)
        self.rest_log = math.log10(self.rest_total + rest_distinct + 1)

    def counts(self) -> np.ndarray:
        """The training count of each of the network's ids."""
        found = np.zeros(self.side**2)
        found[gru.UNKNOWN], found[gru.END] = self.rest_total, self.end
        found[2 : 2 + len(self.own_counts)] = self.own_counts
        return found


def head_tokens(counts: DataFrame, most: int) -> DataFrame:
    """``most`` of the most frequent tokens, or a few less.

    The least count follows from the histogram of counts, which has few rows. Of the tokens with the count at which
    the head ends, those with the lowest hashes are taken, again by a histogram; so no top list is gathered.
    """
    ranks = counts.groupBy("c").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("c"))))
    last = ranks.where(F.col("upto") > most).orderBy(F.desc("c")).first()
    if last is None:
        return counts
    buckets = 1 << 16
    at = F.pmod(F.xxhash64("token"), F.lit(buckets))
    tied = counts.where(F.col("c") == last["c"]).groupBy(at.alias("at")).agg(F.count("*").alias("n"))
    upto = tied.withColumn("upto", F.sum("n").over(Window.orderBy("at"))).where(F.col("upto") > most - last["upto"] + last["n"])
    edge = upto.agg(F.min("at")).first()[0]
    return counts.where((F.col("c") > last["c"]) | ((F.col("c") == last["c"]) & (at < F.lit(edge))))


def vocabulary(counts: DataFrame, head: int = HEAD, side: int = 0) -> Vocabulary:
    is_end = F.col("token") == F.lit(END_TOKEN).cast("binary")
    total, distinct, end = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(is_end, F.col("c"))), F.lit(0))).first()
    found = {bytes(t): c for t, c in head_tokens(counts.where(~is_end), head).collect()}
    order = sorted(found, key=lambda t: (-found[t], t))
    return Vocabulary(total, distinct, end, {t: found[t] for t in order}, side)


def encoded(docs: DataFrame, sent: Broadcast, parts: int) -> DataFrame:
    """One row for each of ``docs``: its ids for the network (int16) and what the head says about it.

    ``part`` is one of ``parts`` for training documents and null for those held out; ``rare`` has the tokens outside
    the head with their numbers.
    """
    part = F.when(~held_out("doc_id", MOD, REMAINDER), F.pmod(F.xxhash64("text", "doc_id"), F.lit(parts))).cast("int")
    rows = docs.select(row_id(), "doc_id", part.alias("part"), "text")
    longs, doubles = ("n_tokens", "head_known", "n_other"), ("own_log", "other_log")
    schema = rows.drop("text").schema
    for names, kind in ((longs, "long"), (doubles, "double")):
        for name in names:
            schema = schema.add(name, kind)
    schema = schema.add("ids", "binary").add("rare", ArrayType(StructType().add("token", "binary").add("n", "long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = sent.value
        own, last = len(voc.own_counts), math.log10(voc.end + 1)
        logs = np.log10(np.fromiter(voc.head.values(), np.float64, len(voc.head)) + 1)
        head = pa.array(list(voc.head), pa.binary())
        for batch in batches:
            for first, end, words, owner in words_of(batch.column(3)):
                n = end - first
                at = pc.fill_null(pc.index_in(words, value_set=head), -1).to_numpy(zero_copy_only=False)
                known, mine = at >= 0, (at >= 0) & (at < own)
                other = known & ~mine
                sizes, mines = np.bincount(owner, minlength=n), np.bincount(owner[mine], minlength=n)
                stats = (sizes + 1, np.bincount(owner[known], minlength=n) + (voc.end > 0), sizes - mines)
                sums = (np.bincount(owner[mine], logs[at[mine]], n) + last, np.bincount(owner[other], logs[at[other]], n))
                # Each text's ids and then the end, in one array.
                stops = np.cumsum(sizes + 1)
                ids = np.full(int(stops[-1]), gru.END, np.uint16)
                ids[np.arange(len(at)) + owner] = np.where(mine, at + 2, gru.UNKNOWN)
                # Words outside the head, counted by row.
                rare = words.filter(pa.array(~known)).dictionary_encode()
                kinds = max(1, len(rare.dictionary))
                keys, times = np.unique(owner[~known] * kinds + rare.indices.to_numpy(), return_counts=True)
                edges = np.searchsorted(keys, np.arange(n + 1) * kinds).astype(np.int32)
                listed = pa.StructArray.from_arrays([rare.dictionary.take(pa.array(keys % kinds)), pa.array(times, pa.int64())], ["token", "n"])
                laid = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.r_[0, 2 * stops].astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, n) for c in batch.columns[:3]), *(pa.array(c, pa.int64()) for c in stats), *(pa.array(c, pa.float64()) for c in sums), laid, pa.ListArray.from_arrays(pa.array(edges), listed)], schema.names
                )

    return rows.mapInArrow(run, schema)


def averaged(parts: DataFrame, count: int) -> DataFrame:
    """part, n, params: at most ``AVERAGES`` means, weighted by n, of ``count`` parts numbered from 0."""

    def average(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("part")
        made = gru.mean([(gru.load(x), n) for x, n in zip(df["params"], df["n"], strict=True)])
        return pd.DataFrame({"part": [int(df["part"].iloc[0]) // FAN], "n": [df["n"].sum()], "params": [gru.dump(made)]})

    while count > AVERAGES:
        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("into")).applyInPandas(average, "part int, n double, params binary")
        count = -(-count // FAN)
    return parts


def train(rows: DataFrame, words: Vocabulary, replicas: int, hidden: int = HIDDEN, embed: int = EMBED, rounds: int = ROUNDS) -> gru.Params:
    """Parameters after ``rounds`` of averaging over replicas; the training rows of ``encoded`` are dealt to rounds and replicas."""
    params = gru.initial(words.side, words.side, hidden, embed, words.counts())
    sc = rows.sparkSession.sparkContext
    for k in range(rounds):
        start = sc.broadcast(params)

        def replica(df: pd.DataFrame) -> pd.DataFrame:
            laid = [np.frombuffer(x, np.uint16) for x in df.sort_values(["doc_id", "ids"])["ids"]]
            made = gru.train(start.value, laid)
            return pd.DataFrame({"part": [int(df["part"].iloc[0]) // rounds], "n": [float(sum(map(len, laid)))], "params": [gru.dump(made)]})

        own = rows.where(F.col("part") % rounds == k).select("part", "doc_id", "ids")
        trained = own.groupBy("part").applyInPandas(replica, "part int, n double, params binary")
        parts = averaged(trained, replicas).collect()
        if parts:
            params = gru.mean([(gru.load(bytes(r["params"])), r["n"]) for r in sorted(parts, key=lambda r: r["part"])])
    return params


def rare_sums(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rid, rare_log, rare_known: sums over the tokens outside the head that occur in training."""
    rare = rows.select("rid", F.explode("rare").alias("r")).select("rid", "r.token", "r.n")
    met = rare.join(counts, "token")
    return met.groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum("n").alias("rare_known"))


def network_sums(rows: DataFrame, params: gru.Params) -> DataFrame:
    """The rows of ``encoded`` without ids and rare tokens, with ``network``, the log10 likelihood of the ids."""
    net = rows.sparkSession.sparkContext.broadcast(params)
    rows = rows.select(*(c for c in rows.columns if c not in ("part", "ids", "rare")), "ids")
    schema = rows.drop("ids").schema.add("network", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            laid = [np.frombuffer(x, np.uint16) for x in batch.column(batch.num_columns - 1).to_pylist()]
            at = 0
            while at < len(laid):
                began, size = at, 0
                while at < len(laid) and (size < CHUNK or at == began):
                    size += len(laid[at])
                    at += 1
                ll = gru.log_likelihoods(net.value, laid[began:at]) / math.log(10)
                yield pa.RecordBatch.from_arrays([*(c.slice(began, at - began) for c in batch.columns[:-1]), pa.array(ll)], schema.names)

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    counts = materialize(count_tokens(docs.where(~held_out("doc_id", MOD, REMAINDER))), "token-counts")
    words = vocabulary(counts, head)
    sent = docs.sparkSession.sparkContext.broadcast(words)
    replicas = max(1, round(words.total / rounds / REPLICA_TOKENS))
    rows = materialize(encoded(docs, sent, rounds * replicas), "encoded-documents")
    params = train(rows, words, replicas, rounds=rounds)
    rare = materialize(rare_sums(rows, counts), "rare-sums")
    met = materialize(network_sums(rows, params), "network-sums").join(rare, "rid", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    other = F.col("other_log") + rare_log
    return met.select(
        "doc_id",
        held_out("doc_id", MOD, REMAINDER).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("own_log") + other - F.col("n_tokens") * F.lit(words.base_log)).alias("base_score"),
        (F.col("network") + other - F.col("n_other") * F.lit(words.rest_log)).alias("score"),
    )
