"""Semantic constants of retrieval, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    chunk_size: int = 1200
    chunk_overlap: int = 150
    table_chunk_size: int = 3000
    min_chunk: int = 10
    top_k: int = 30
    rerank_top_k: int = 12
    min_similarity: float = 0.30
    semantic_weight: float = 0.70
    diversity_threshold: float = 0.70
    reranker_weight: float = 0.3
    rerank_min_score: float = -5.0
    low_relevance_limit: int = 3
    max_context: int = 24576
    memory_floor: float = 0.50
    memory_duplicate: float = 0.92

    def __post_init__(self) -> None:
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be less than chunk_size")
        if self.rerank_top_k > self.top_k:
            raise ValueError("rerank_top_k must not exceed top_k")


DEFAULT = Params()
