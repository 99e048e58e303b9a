"""Settings of retrieval and evaluation; every operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    max_chunk_tokens: int = 420
    min_chunk_tokens: int = 24
    query_prefix: str = "Represent this sentence for searching relevant passages: "
    top_k: int = 6
    rrf_k: int = 60
    pool: int = 30
    mode: str = "hybrid"
    weighted_kind: str = "recital"
    kind_weight: float = 0.5
    abstain: str = "NOT_IN_CORPUS"
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_floor: float = 0.25
    ks: tuple[int, ...] = (3, 5, 10)
    weights: tuple[float, ...] = (1.0, 0.75, 0.5, 0.25, 0.0)
    usage_fraction: float = 0.75
    tokens_per_minute: int = 8000
    window_seconds: int = 60
    max_claims: int = 20
    reply_tokens: int = 2500


DEFAULT = Settings()
