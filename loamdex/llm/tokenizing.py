"""Encoding texts with a public byte-level BPE vocabulary.

The words of a batch (as the vocabulary's pre-tokenizer cuts them) are made
distinct and laid out as a trie: sorted, each word shares with the one before
the nodes of their common prefix, and a depth-first walk is a pass over them in
order with a stack of states. The state of a node is the last token of the
encoding of its prefix. A prefix ends in token ``t`` exactly if the shorter
prefix without ``t`` ends in a token that stands next to ``t`` unmerged, so a
node's state follows from its ancestors' and shared prefixes are encoded once.

Defined results: null and empty texts have the empty list; strings of special
tokens in a text are ordinary text; every row gives one row, repeated ids too;
lone surrogates cannot occur in Spark's strings.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_FOLDER = "/opt/tokenizers"
DEFAULT_VOCABULARY = "byte_bpe_50k"
#: How the vocabulary's training text was cut into words (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: The greatest file that is taken for a vocabulary; it is sent to every executor.
MOST_BYTES = 64 << 20


def vocabulary(path: str | None = None) -> bytes:
    """The file of a vocabulary, read on the driver; executors need no copy of it on their disks."""
    path = path or vocabulary_path()
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} is too large for a vocabulary")
    with open(path, "rb") as f:
        return f.read()


def vocabulary_path(folder: str = DEFAULT_FOLDER, name: str = DEFAULT_VOCABULARY) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


class TrieEncoder:
    """Encodes words of one vocabulary; keeps what it learnt between batches."""

    def __init__(self, vocabulary: bytes, keep_words: int = 200_000, keep_pairs: int = 1_000_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.suffixes = {t[i:] for t in self.ranks for i in range(len(t))}
        self.words = regex.compile(WORDS)
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.keep_words, self.keep_pairs = keep_words, keep_pairs

    def merged(self, word: bytes) -> list[int]:
        """Plain byte pair merging, for the few pieces whose neighbourhood is asked for."""
        parts, ranks = [word[i : i + 1] for i in range(len(word))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def beside(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` is how their joined bytes are encoded; -1 is the word's start."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if left < 0:
                known = self.merged(self.bytes_of[right]) == [right]
            else:
                known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self.pairs) >= self.keep_pairs:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def learn(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The encodings of distinct words, by one walk over their trie."""
        ranks, suffixes, beside = self.ranks, self.suffixes, self.beside
        out: dict[str, tuple[int, ...]] = {}
        states, lengths, last = [-1], [0], b""  # per node of the current branch: its last token and that token's length
        for data, word in sorted((w.encode(), w) for w in words):
            shared, most = 0, min(len(last), len(data))
            while shared < most and last[shared] == data[shared]:
                shared += 1
            del states[shared + 1 :], lengths[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                size = 1
                while True:
                    piece = data[end - size : end]
                    token = ranks.get(piece)
                    if token is not None and beside(states[end - size], token):
                        states.append(token)
                        lengths.append(size)
                        break
                    size += 1
                    if size > end or data[end - size : end] not in suffixes:
                        raise ValueError("the vocabulary lacks single bytes")
            ids, at = [], len(data)
            while at:
                ids.append(states[at])
                at -= lengths[at]
            out[word] = tuple(reversed(ids))
            last = data
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.words.findall(t) if t else [] for t in texts]
        new = {w for words in cut for w in words if w not in self.known}
        if new:
            if len(self.known) + len(new) > self.keep_words:
                self.known.clear()
                new = {w for words in cut for w in words}
            self.known.update(self.learn(new))
        known = self.known
        return [[i for w in words for i in known[w]] for words in cut]


_ENCODERS: dict[int, TrieEncoder] = {}


def encoder(sent: Broadcast) -> TrieEncoder:
    """The worker's encoder for a vocabulary that was sent; made once a process."""
    key = zlib.crc32(sent.value)
    if key not in _ENCODERS:
        _ENCODERS[key] = TrieEncoder(sent.value)
    return _ENCODERS[key]


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def encode(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row. Needs no shuffle: each task encodes its own rows."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent)
        for batch in _small(batches):
            ids = enc.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return documents.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """The rows of ``documents`` without the text, with their number of tokens as ``tokens``.

    ``keep`` columns come through; a column already named ``tokens`` is replaced.
    """
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary(path))
    kept = [c for c in documents.columns if c not in (text, "tokens")]
    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent)
        for batch in _small(batches):
            n = [len(x) for x in enc.encode_batch(batch.column(batch.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*kept, "tokens"])

    return documents.select(*[F.col(c) for c in kept], F.col(text).cast("string").alias("_text")).mapInArrow(run, f"{fields}, tokens bigint")
