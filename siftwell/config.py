"""Settings of the operators, in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Defaults are the effective production values."""

    min_passage_chars: int = 40
    encoder_limit: int = 512
    encoder_margin: int = 8
    chunk_sizes: dict = field(default_factory=lambda: {"fixed": (64, 0), "sliding": (64, 16), "recursive": (96, 24), "semantic": (128, 0), "passage_native": (512, 0), "parent_child": (48, 12), "indic_aware": (96, 24)})
    semantic_percentile: float = 78.0
    top_k: int = 10
    candidates: int = 40
    rrf_k: int = 60
    dense_weight: float = 1.0
    sparse_weight: float = 0.0
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    min_query_chars: int = 3
    max_query_chars: int = 512
    languages: tuple = ("en", "hi", "gu")
    relevance_default: float = 0.884
    relevance_by_lang: dict = field(default_factory=lambda: {"en": 0.884, "hi": 0.880, "gu": 0.877})
    min_margin: float = 0.0
    min_overlap: float = 0.231
    min_similarity: float = 0.794
    sentence_overlap: float = 0.12
    extractive_min_score: float = 0.86
    extractive_min_span: float = 0.80
    extractive_join: float = 0.04
    max_span_chars: int = 400
    citation_chars: int = 600
    cache_similarity: float = 0.95
    cache_entries: int = 2048
    cache_ttl_seconds: float = 3600.0
    breaker_failures: int = 3
    breaker_reset_seconds: float = 30.0
    target_fpr: float = 0.10
    min_tpr: float = 0.0
    core_budget_ms: float = 200.0
    core_stages: tuple = ("guard_input", "embed", "cache", "retrieve", "rerank", "guard_relevance", "extract", "guard_grounding")


DEFAULT = Settings()
