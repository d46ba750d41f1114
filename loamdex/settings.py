"""Settings of the engine: defaults, overridden by ``LOAMDEX_`` environment variables."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from loamdex.operators.embed import Embedder, HashEmbedder, ServiceEmbedder

OFF = ("0", "false", "no")


@dataclass(frozen=True)
class Settings:
    """``embed_backend`` is service, hash or local; numbers below their least value count as that."""

    config_home: str = "~/.config/loamdex"
    cache_home: str = "~/.cache/loamdex"
    index: str = ""
    root: str = "."
    log_level: str = "INFO"
    slow_tool_seconds: float = 2.0
    log_max_bytes: int = 1_048_576
    log_backups: int = 5
    semantic: bool = True
    embed_backend: str = "hash"
    embed_model: str = ""
    embed_api_base: str = ""
    embed_api_key: str = ""
    embed_dim: int = 256
    embed_batch: int = 64
    embed_concurrency: int = 6
    embed_retries: int = 3
    embed_timeout: float = 120.0
    embed_search_timeout: float = 45.0
    embed_search_retries: int = 0
    embed_query_cache: int = 256
    search_score: float = 0.0
    doc_max_bytes: int = 131_072
    warm_interval: float = 120.0

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        least = {"log_max_bytes": 1024, "embed_batch": 1, "embed_concurrency": 1, "embed_timeout": 1.0, "embed_search_timeout": 1.0, "embed_dim": 1}
        given = {}
        for f in fields(cls):
            raw = env.get("LOAMDEX_" + f.name.upper())
            if raw is None:
                continue
            kind = type(f.default)
            value = raw.strip().lower() not in OFF if kind is bool else kind(raw)
            given[f.name] = max(least.get(f.name, 0), value) if kind in (int, float) and f.name != "search_score" else value
        return cls(**given)

    @property
    def registry(self) -> str:
        return os.path.join(os.path.expanduser(self.config_home), "services.toml")

    @property
    def index_folder(self) -> str:
        return self.index or os.path.join(os.path.expanduser(self.cache_home), "index")

    @property
    def status_folder(self) -> str:
        return os.path.join(os.path.expanduser(self.cache_home), "status")

    @property
    def log_file(self) -> str:
        return os.path.join(os.path.expanduser(self.cache_home), "logs", "tools.log")


def embedder(s: Settings) -> Callable[[], Embedder] | None:
    """What makes the configured embedder on an executor; None if the vector layer is off."""
    if not s.semantic:
        return None
    if s.embed_backend == "hash":
        return lambda: HashEmbedder(s.embed_dim)
    if s.embed_backend == "local":
        return lambda: LocalEmbedder(s.embed_model)
    return lambda: ServiceEmbedder(
        s.embed_api_base, s.embed_model, s.embed_api_key, batch=s.embed_batch, parallel=s.embed_concurrency, retries=s.embed_retries, timeout=s.embed_timeout,
        search_timeout=s.embed_search_timeout, search_retries=s.embed_search_retries, remember=s.embed_query_cache,
    )


class LocalEmbedder:
    """A model on this machine, through the optional package ``fastembed``."""

    def __init__(self, model: str):
        try:
            from fastembed import TextEmbedding
        except ImportError as e:
            raise RuntimeError("the local embedder needs the package fastembed") from e
        self.model = TextEmbedding(model) if model else TextEmbedding()

    def embed(self, texts) -> list[list[float]]:
        return [[float(x) for x in v] for v in self.model.embed(list(texts))]
