"""Embedding texts: a protocol, a client for embedding services, and an offline embedder."""

from __future__ import annotations

import hashlib
import json
import math
import time
import urllib.request
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.operators.ftsquery import tokens_of


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class EmbeddingError(ValueError):
    """A service's answer cannot be used."""


class HashEmbedder:
    """Signed hashing of tokens into a fixed number of dimensions; needs no model and no network."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        out = [0.0] * self.dimensions
        for t in tokens_of(text):
            h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
            out[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        length = math.sqrt(sum(x * x for x in out))
        return [x / length for x in out] if length else out


def parsed(body: bytes | str, wanted: int) -> list[list[float]]:
    """The vectors of a service's answer, in order of their index; raises ``EmbeddingError`` if anything is off."""
    try:
        data = json.loads(body)
    except ValueError as e:
        raise EmbeddingError("not JSON") from e
    if not isinstance(data, dict):
        raise EmbeddingError("not an object")
    if "data" not in data and isinstance(data.get("error"), (dict, str)):
        raise EmbeddingError(f"service error: {data['error']}")
    items = data.get("data")
    if not isinstance(items, list) or len(items) != wanted:
        raise EmbeddingError("wrong number of vectors")
    out: list[list[float]] = []
    for item in sorted(items, key=lambda x: x.get("index", 0) if isinstance(x, dict) and isinstance(x.get("index", 0), int) else 0):
        v = item.get("embedding") if isinstance(item, dict) else None
        if not isinstance(v, list) or not v:
            raise EmbeddingError("missing vector")
        try:
            numbers = [float(x) for x in v]  # numbers written as text are numbers
        except (TypeError, ValueError) as e:
            raise EmbeddingError("not numbers") from e
        if not all(map(math.isfinite, numbers)):
            raise EmbeddingError("not finite")
        out.append(numbers)
    if len({len(v) for v in out}) > 1:
        raise EmbeddingError("unequal dimensions")
    return out


class ServiceEmbedder:
    """Batches texts to a service in parallel, tries again, and remembers queries."""

    def __init__(self, url: str, model: str, key: str = "", batch: int = 64, parallel: int = 6, retries: int = 3, timeout: float = 120.0, search_timeout: float = 45.0, search_retries: int = 0, remember: int = 256, post: Callable[[dict, float], bytes] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.url, self.model, self.key, self.batch, self.parallel, self.retries = url, model, key, batch, parallel, retries
        self.timeout, self.search_timeout, self.search_retries, self.remember, self.sleep = timeout, search_timeout, search_retries, remember, sleep
        self.post = post or self._post
        self.known: OrderedDict[str, list[float]] = OrderedDict()

    def _post(self, payload: dict, timeout: float) -> bytes:
        request = urllib.request.Request(self.url.rstrip("/") + "/embeddings", json.dumps(payload).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.read()

    def _try(self, texts: Sequence[str], retries: int, timeout: float, longest: float = 8.0) -> list[list[float]]:
        for n in range(retries + 1):
            try:
                return parsed(self.post({"model": self.model, "input": list(texts)}, timeout), len(texts))
            except Exception:
                if n == retries:
                    raise
                self.sleep(min(longest, 0.5 * 2**n))
        raise AssertionError

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        parts = [texts[i : i + self.batch] for i in range(0, len(texts), self.batch)]
        with ThreadPoolExecutor(self.parallel) as pool:
            return [v for part in pool.map(lambda p: self._try(p, self.retries, self.timeout), parts) for v in part]

    def embed_query(self, text: str) -> list[float]:
        if text in self.known:
            self.known.move_to_end(text)
            return self.known[text]
        vector = self._try([text], self.search_retries, self.search_timeout, 2.0)[0]
        self.known[text] = vector
        while len(self.known) > self.remember:
            self.known.popitem(last=False)
        return vector


def embedded(chunks: DataFrame, make: Callable[[], Embedder], text: str = "chunk", batch: int = 384) -> DataFrame:
    """``chunks`` with ``embedding`` and ``failed``: a batch that fails has no vectors and says so."""
    kept = [c for c in chunks.columns if c not in ("embedding", "failed")]
    fields = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in kept)
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make()
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                part = whole.slice(i, batch)
                try:
                    vectors: list = embedder.embed([t or "" for t in part.column(at).to_pylist()])
                    if len(vectors) != part.num_rows:
                        raise EmbeddingError("wrong number of vectors")
                except Exception:
                    vectors = [None] * part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array([v is None for v in vectors])], names=[*kept, "embedding", "failed"])

    return chunks.select(*[F.col(c) for c in kept]).mapInArrow(run, f"{fields}, embedding array<float>, failed boolean")
