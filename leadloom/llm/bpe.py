"""Byte-pair encoding by prefix dynamic programming.

Of all tokens that end at byte i of a word, exactly one is the last token of the word's encoding up to i: the one that forms a
valid pair with the last token of the prefix before it. So one pass stores a last token per prefix, the encoding is read off
backwards, an append goes on from the stored column, and an edit keeps the columns before it. Candidates for each position come
from a multi-pattern automaton over the vocabulary. Pair validity is found once per pair by merging the two tokens' bytes and
kept in a table.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies lie.
TOKENIZERS = os.environ.get("LEADLOOM_TOKENIZERS", "/opt/tokenizers")
#: How the vocabulary's texts are first cut into words (fixed by the vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries a worker keeps of words and of pairs; a full table is emptied, which costs time and changes no result.
MEMORY = 500_000


class Vocabulary:
    """A byte-level vocabulary whose ids are the merge ranks, with its automaton and pair table."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            if self.merge(token) == [token]:  # only tokens that their own bytes are encoded as can occur
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def of_text(cls, text: bytes) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line)})

    def merge(self, word: bytes) -> list[bytes]:
        """Byte-pair encoding by its definition: merge the adjacent pair of lowest rank until none is left. For short inputs."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.ranks.get(parts[k] + parts[k + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def joins(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together are encoded as just these two."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            a, b = self.bytes_of[left], self.bytes_of[right]
            known = self.pairs[left, right] = self.merge(a + b) == [a, b]
        return known


class Prefixes:
    """The last token of every prefix of one word's bytes."""

    def __init__(self, vocabulary: Vocabulary, word: bytes = b""):
        self.vocabulary, self.word = vocabulary, b""
        self.last: list[int] = []  # last[i]: id of the last token of the first i + 1 bytes
        self.size: list[int] = []
        self.append(word)

    def append(self, more: bytes) -> Prefixes:
        """Encode ``more`` after what is there; the columns of the present bytes stay."""
        done = len(self.word)
        self.word += more
        if not more:
            return self
        begin = max(0, done - self.vocabulary.longest)  # no token begins further back
        found: list[list[tuple[int, int]]] = [[] for _ in more]
        for end, match in self.vocabulary.automaton.iter(self.word[begin:].decode("latin-1")):
            at = begin + end
            if at >= done and match[1] <= at + 1:
                found[at - done].append(match)
        joins, last, size = self.vocabulary.joins, self.last, self.size
        for k, matches in enumerate(found):
            at = done + k
            for token, length in matches:  # the longest come first
                before = at - length
                if before < 0 or joins(last[before], token):
                    last.append(token)
                    size.append(length)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return self

    def replace(self, begin: int, end: int, by: bytes) -> Prefixes:
        """Put ``by`` for bytes begin to end; columns before ``begin`` are kept, later ones are made anew."""
        rest = by + self.word[end:]
        self.word = self.word[:begin]
        del self.last[begin:], self.size[begin:]
        return self.append(rest)

    def ids(self) -> list[int]:
        out, at = [], len(self.word) - 1
        while at >= 0:
            out.append(self.last[at])
            at -= self.size[at]
        return out[::-1]


class Encoder:
    """Whole texts: words by the pattern, each word by its prefixes, frequent words from memory."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        import regex

        self.vocabulary, self.cut = vocabulary, regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            ids = Prefixes(self.vocabulary, word.encode()).ids()
            if len(word) <= 64:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; strings of special tokens are ordinary text; null and empty give the empty list."""
        out: list[int] = []
        for word in self.cut.findall(text or ""):
            out += self.word(word)
        return out


class EditableText:
    """An encoded text that is appended to and edited near places without encoding the rest again."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.words, self.parts = encoder, [], []
        self._put(0, 0, encoder.cut.findall(text))

    def _put(self, begin: int, end: int, words: list[str]) -> None:
        self.words[begin:end] = words
        self.parts[begin:end] = [self.encoder.word(w) for w in words]

    @property
    def text(self) -> str:
        return "".join(self.words)

    def append(self, more: str) -> EditableText:
        """The last two words are cut anew together with ``more``: no earlier cut depends on what follows."""
        keep = max(0, len(self.words) - 2)
        self._put(keep, len(self.words), self.encoder.cut.findall("".join(self.words[keep:]) + more))
        return self

    def replace(self, begin: int, end: int, by: str) -> EditableText:
        """Characters begin to end become ``by``. Cut anew from two words before the edit until the new cuts meet old ones."""
        at, first = 0, 0
        while first < len(self.words) and at + len(self.words[first]) < begin:
            at += len(self.words[first])
            first += 1
        first = max(0, first - 2)
        head = sum(map(len, self.words[:first]))
        stop, tail = first, head
        while stop < len(self.words) and tail < end:
            tail += len(self.words[stop])
            stop += 1
        stop = min(len(self.words), stop + 2)
        while True:
            old = "".join(self.words[first:stop])
            fresh = self.encoder.cut.findall(old[: begin - head] + by + old[end - head :])
            # the cuts meet when the last old word of the window comes out whole again
            if stop == len(self.words) or (fresh and self.words[stop - 1] == fresh[-1] and fresh[-1].strip()):
                self._put(first, stop, fresh)
                return self
            stop = min(len(self.words), stop + 8)

    def ids(self) -> list[int]:
        return [i for part in self.parts for i in part]


_OF_WORKER: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per Python worker and vocabulary; the vocabulary comes as a broadcast of under 1 MB."""
    text = shared.value
    key = hash(text)
    if key not in _OF_WORKER:
        _OF_WORKER[key] = Encoder(Vocabulary.of_text(text))
    return _OF_WORKER[key]


def vocabulary_text(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as file:
        return file.read()


def _workers(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Spread small inputs that come in few files over all cores; rows move once, before the costly step."""
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * 2)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): the ids of each row's whole text, without special tokens.

    Null and empty texts give an empty list, never null. One row per input row, repeated and null keys included; other columns
    aren't read, whatever their names; an empty table gives an empty result. No grouping, so no skew: a long text is encoded in
    time linear in its length.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary_text(tokenizer, folder))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                some = batch.slice(begin, 1000)
                ids = pa.array([encoder.encode(t) for t in some.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), ids], names=["key", "ids"])

    read = _workers(spark, df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    return read.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens): the length of each row's encoding; 0 for null and empty texts."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary_text(tokenizer, folder))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared)
        for batch in batches:
            sizes = [sum(len(encoder.word(w)) for w in encoder.cut.findall(t)) if t else 0 for t in batch.text]
            yield pd.DataFrame({"key": batch.key, "n_tokens": pd.Series(sizes, index=batch.index, dtype="int64")})

    read = _workers(spark, df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    return read.mapInPandas(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)
