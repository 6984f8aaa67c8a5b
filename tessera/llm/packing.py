"""Cost-balanced packing of tokenised documents into sequences.

A document's token ids are cut into pieces whose lengths are powers of two: whole sequences first, then the
binary digits of the rest. Longest first, every piece goes to the sequence with the lowest estimated cost
(linear in the tokens plus quadratic in each piece, as attention within documents costs) that still has room
for it. As lengths are powers of two in descending order, a sequence with room left has room for the piece, so
all sequences of a group but a few tokens at its end are full.

Pieces are dealt by hash into groups of about ``GROUP`` sequences, so a group is bounded whatever the input;
each group is packed on its own and wastes less than one sequence. Only lengths and checksums are shuffled,
never ids or texts.

Null and empty texts have only the closing id. Rows that repeat a doc_id are packed one by one. An empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import row_id
from tessera.session import materialize

SEQUENCE = 2048
CLOSING_ID = 1
#: Sequences in a group.
GROUP = 1024
#: Words whose ids a Python worker remembers, from one task to the next.
REMEMBERED = 700_000
#: Texts that are encoded together.
SLICE = 128


#: How the vocabulary splits words of ASCII letters (lower-cased) or of Latin letters, given one to a line.
_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\n]+|\n")
_LATIN = re.compile(r"'[sStTmMdD]|'[rR][eE]|'[vV][eE]|'[lL][lL]|[^\W\d_]+|[0-9]|(?:[^\w\n]|_)+|\n")
_LATIN_ONLY = re.compile(r"[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: Stands for the end of a line among ids; as every id is below 2^16, no four bytes of ids look like it.
_LINE_END = b"\xff\xff\xff\xff"
_LINES = {b"\n": _LINE_END, "\n": _LINE_END}


class WordEncoder:
    """Ids of whole texts, word by word.

    The vocabulary splits at white space and never joins words, so a text's ids are its words' ids in turn; and
    a word's ids are those of its letter runs, digits and marks. Both are remembered, up to a limit each, as
    little-endian unsigned 32-bit bytes. Words that are not known yet are split and put together as one text with a
    word on each line; parts that are not known are encoded in one call and told apart by their word-end tokens. Words
    beyond Latin letters go to the tokenizer whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must be below 2^16")
        self.remembered, self.ids, self.parts = remembered, {}, {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_parts(self, found: set) -> None:
        new = list(found.difference(self.parts))
        if len(self.parts) + len(new) > 2 * self.remembered:
            self.parts.clear()
            new = list(found)
        if not new:
            return
        texts = [p.decode() if isinstance(p, bytes) else p for p in new]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(new):
            raw, at = ids.tobytes(), (4 * stops).tolist()
            self.parts.update(zip(new, (raw[a:b] for a, b in zip([0, *at], at, strict=False)), strict=True))
        else:
            self.parts.update((p, self._whole(t)) for p, t in zip(new, texts, strict=True))

    def _learn(self, words: list[bytes]) -> None:
        plain, other = [], []
        for w in words:
            (plain if w.isascii() and b"<|" not in w else other).append(w)
        latin = [(w, t) for w in other if b"<|" not in w and _LATIN_ONLY.fullmatch(t := w.decode("utf-8", "replace"))]
        lines = [_ASCII.findall(b"\n".join(plain).lower()), _LATIN.findall("\n".join(t for _, t in latin))]
        self._learn_parts(set().union(*lines).difference(_LINES))
        self.parts.update(_LINES)
        for alike, parts in zip((plain, [w for w, _ in latin]), lines, strict=True):
            if alike:
                self.ids.update(zip(alike, b"".join(map(self.parts.__getitem__, parts)).split(_LINE_END), strict=True))
        for w in other:
            if w not in self.ids:
                self.ids[w] = self._whole(w.decode("utf-8", "replace"))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        known = self.ids
        found = set().union(*split)
        missing = list(found.difference(known))
        if missing:
            if len(known) + len(missing) > self.remembered:
                known.clear()
                missing = list(found)
            self._learn(missing)
        return [b"".join(map(known.__getitem__, words)) for words in split]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """The encoder of a Python worker: the next task finds the words that the last one met."""
    return WordEncoder(path)


def cuts(n: int, sequence: int = SEQUENCE) -> list[int]:
    """Lengths of the pieces of ``n`` ids: whole sequences, then descending powers of two."""
    rest = n % sequence
    return [sequence] * (n // sequence) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, closing_id: int = CLOSING_ID) -> DataFrame:
    """rid, doc_id, start, length, ids_crc32, doc_tokens for every piece of every row."""
    if sequence & (sequence - 1):
        raise ValueError("the length of a sequence must be a power of two")
    rows = docs.select(row_id(), "doc_id", "text")
    schema = rows.drop("text").schema
    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(vocabulary), np.array([closing_id], "<u4").tobytes()
        for batch in batches:
            at, out = [], []
            texts = batch.column(2).to_pylist()
            encoded = (ids for lo in range(0, len(texts), SLICE) for ids in encoder.encode(texts[lo : lo + SLICE]))
            for i, ids in enumerate(encoded):
                ids += end
                n, start = len(ids) // 4, 0
                for length in cuts(n, sequence):
                    at.append(i)
                    out.append((start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), n))
                    start += length
            columns = np.array(out, np.int64).reshape(-1, 4).T
            taken = batch.select([0, 1]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, *map(pa.array, columns)], schema.names)

    return rows.mapInArrow(run, schema)


def assign(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for each of the ``lengths``, which must be in descending order."""
    count = -(-int(lengths.sum()) // sequence)
    heap = [(0.0, k, 0) for k in range(count)]
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        aside = []
        while heap and heap[0][2] + n > sequence:
            aside.append(heapq.heappop(heap))
        cost, k, used = heapq.heappop(heap) if heap else (0.0, count, 0)
        count += k == count
        place[i], offset[i] = k, used
        for full in aside:
            if full[2] < sequence:
                heapq.heappush(heap, full)
        heapq.heappush(heap, (cost + n + n * n / sequence, k, used + n))
    return place, offset


def pack(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, group: int = GROUP, closing_id: int = CLOSING_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece."""
    cut = materialize(pieces(docs, vocabulary, sequence, closing_id), "pieces")
    tokens = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(tokens / (sequence * group)))
    schema = cut.drop("rid").schema.add("sequence_id", "long").add("offset", "long")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "rid", "start"], ascending=[False, True, True], kind="stable")
        place, offset = assign(df["length"].to_numpy(), sequence)
        return df.assign(sequence_id=(df["group"].to_numpy() << 32) + place, offset=offset)[schema.names]

    dealt = cut.withColumn("group", F.pmod(F.xxhash64("rid", "start"), F.lit(groups)).cast("long"))
    return dealt.groupBy("group").applyInPandas(run, schema)
