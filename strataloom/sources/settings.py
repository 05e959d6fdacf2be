"""Settings: environment over .env over Spark configuration (strataloom.*) over defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class ParserSettings:
    max_file_size_bytes: int = 1 << 20
    context_lines: int = 3
    include_unknown: bool = False


@dataclass(frozen=True)
class ChunkerSettings:
    strategy: str = "ast"
    chunk_size: int = 512
    chunk_overlap: int = 64
    min_chunk_size: int = 20
    max_chunk_size: int = 2048


@dataclass(frozen=True)
class EmbeddingSettings:
    provider: str = "hashing"
    model: str = "hashing-256"
    dimensions: int = 256
    batch_size: int = 64


@dataclass(frozen=True)
class VectorstoreSettings:
    path: str = "index/vectors"
    metric: str = "cosine"


@dataclass(frozen=True)
class GraphSettings:
    enabled: bool = False
    path: str = "index/graph"


@dataclass(frozen=True)
class LlmSettings:
    model: str = ""
    max_tokens: int = 512
    temperature: float = 0.0
    concurrency: int = 20


@dataclass(frozen=True)
class ApiSettings:
    host: str = "127.0.0.1"
    port: int = 8000
    api_key: str = ""


@dataclass(frozen=True)
class Settings:
    parser: ParserSettings = field(default_factory=ParserSettings)
    chunker: ChunkerSettings = field(default_factory=ChunkerSettings)
    embedding: EmbeddingSettings = field(default_factory=EmbeddingSettings)
    vectorstore: VectorstoreSettings = field(default_factory=VectorstoreSettings)
    graph: GraphSettings = field(default_factory=GraphSettings)
    llm: LlmSettings = field(default_factory=LlmSettings)
    api: ApiSettings = field(default_factory=ApiSettings)


def _parsed(text: str, like):
    if isinstance(like, bool):
        return text.strip().lower() in ("1", "true", "yes", "on")
    return type(like)(text)


def load(env: dict[str, str] | None = None, dotenv: str | None = ".env", spark=None) -> Settings:
    """Settings of the groups PARSER_, CHUNKER_, EMBEDDING_, VECTORSTORE_, GRAPH_, LLM_ and API_."""
    values: dict[str, str] = {}
    if dotenv and Path(dotenv).exists():
        for line in Path(dotenv).read_text().splitlines():
            if "=" in line and not line.lstrip().startswith("#"):
                k, _, v = line.partition("=")
                values[k.strip().upper()] = v.strip().strip("\"'")
    values |= {k.upper(): v for k, v in (os.environ if env is None else env).items()}
    groups = {}
    for g in fields(Settings):
        default = g.default_factory()
        found = {}
        for f in fields(default):
            name, like = f"{g.name}_{f.name}".upper(), getattr(default, f.name)
            text = values.get(name) or (spark.conf.get(f"strataloom.{g.name}.{f.name}", None) if spark else None)
            if text is not None:
                found[f.name] = _parsed(text, like)
        groups[g.name] = type(default)(**found)
    return Settings(**groups)
