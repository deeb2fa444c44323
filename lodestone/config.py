"""Typed settings with defaults; unknown keys are refused. ``${VAR}`` in values is resolved."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields, replace

from lodestone.errors import ConfigError

#: Closed vocabularies of the data model.
DOC_TYPES = ("report", "email", "article", "code", "documentation", "presentation", "resume", "contract", "invoice", "meeting_notes", "other")
ENTITY_KEYS = ("people", "organizations", "locations", "products", "dates")
STATUSES = ("pending", "processing", "done", "failed", "retry", "skipped")
TRANSITIONS = {
    "pending": ("processing", "skipped", "failed"),
    "processing": ("processing", "done", "skipped", "failed"),
    "failed": ("retry", "processing", "failed"),
    "retry": ("processing", "failed"),
    "done": ("processing",),
    "skipped": ("processing",),
}
INTERNAL_FIELDS = ("source", "content_hash", "content", "context_prefix", "chunk_index", "total_chunks", "ingested_at", "file_mtime", "file_size", "section_header")
STOPWORDS = tuple("this that with from have been were they their which about would could should there also more than some only into over such very does will each made when what your then them other most".split())
RETRY_BACKOFF_S = (60, 300, 1800, 7200)


@dataclass(frozen=True)
class Settings:
    """Every parameter of the engine; see the README for their meaning."""

    chunk_size: int = 1024
    chunk_overlap: int = 128
    min_chunk_chars: int = 30
    chunk_strategy: str = "recursive"
    candidate_k: int = 30
    top_k: int = 10
    contextual_search: bool = True
    rrf_k: int = 60
    rrf_mode: str = "standard"
    mmr_fetch_k: int = 20
    mmr_lambda: float = 0.5
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    dense_dim: int = 64
    embed_batch: int = 64
    embed_model: str = "default"
    embed_tries: int = 3
    context_batch: int = 10
    context_max_batches: int = 8
    multi_query: int = 3
    store_buckets: int = 32
    store_segments: int = 24
    max_entities: int = 10
    max_topics: int = 5
    max_keywords: int = 10
    context_chars: int = 12_000
    pack_min_chars: int = 200
    refusal_sentinel: str = "INSUFFICIENT_CONTEXT"
    stale_days: int = 7
    discovery_values: int = 100
    max_retries: int = 4

    @classmethod
    def load(cls, values: dict | None = None) -> Settings:
        """Settings from a flat or nested mapping (nested keys are joined by ``_``)."""
        flat = _flat(values or {})
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if unknown := sorted(set(flat) - set(kinds)):
            raise ConfigError(f"unknown settings: {', '.join(unknown)}")
        return replace(cls(), **{k: _typed(k, v, kinds[k]) for k, v in flat.items()})

    @classmethod
    def from_yaml(cls, path: str) -> Settings:
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("PyYAML is not installed") from e
        with open(path, encoding="utf-8") as f:
            return cls.load(yaml.safe_load(f) or {})


def resolve(value: str, rounds: int = 5) -> str:
    """``${VAR}`` and ``${VAR:-default}`` from the environment, also inside what they give; one that is not set stays as it is."""
    for _ in range(rounds):
        new = re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: os.environ.get(m[1], m[0] if m[2] is None else m[2]), value)
        if new == value:
            break
        value = new
    return value


def _flat(values: dict, prefix: str = "") -> dict:
    out = {}
    for k, v in values.items():
        out |= _flat(v, f"{prefix}{k}_") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def _typed(key: str, value, kind: type):
    value = resolve(value) if isinstance(value, str) else value
    try:
        if kind is bool:
            return str(value).lower() in ("1", "true", "yes")
        return kind(value)
    except (TypeError, ValueError) as e:
        raise ConfigError(f"{key}: {value!r} is no {kind.__name__}") from e
