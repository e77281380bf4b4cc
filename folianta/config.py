"""The engine's parameters, with the values its results are defined by."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # chunks
    chunk_words: int = 350
    overlap_words: int = 60
    least_section_words: int = 200
    # retrieval
    k: int = 8
    most_k: int = 20
    rrf_k: int = 10
    neighbours: int = 2
    rerank_chars: int = 700
    dims: int = 64
    # lexical index
    k1: float = 1.2
    b: float = 0.75
    alias_weight: float = 0.3
    # reuse
    shingle_words: int = 8
    least_content_words: int = 4
    # entities
    most_entities: int = 2
    least_entity_idf: float = 5.0
    # audits
    quote_words: int = 6
    # prices per million tokens
    price_in: float = 1.25
    price_out: float = 10.0
    price_embedding: float = 0.13
    cached_discount: float = 0.25


DEFAULTS = Settings()
