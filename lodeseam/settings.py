"""Settings with their checks; one immutable object instead of values read here and there."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    retrieval_top_k: int = 15
    degraded_top_k: int = 25
    rerank_cascade: tuple[int, ...] = (10, 7, 5)
    mmr_weight: float = 0.7
    max_context_tokens: int = 50_000
    whole_corpus_share: float = 0.75
    agent_mode: str = "react"
    agent_steps: int = 6
    raptor_max_level: int = 3
    embed_provider: str = "hashing"
    embed_model: str = "minnow-64"
    embed_revision: str = ""

    def __post_init__(self) -> None:
        if self.agent_mode not in ("react", "ircot"):
            raise ValueError("agent_mode must be react or ircot")
        if not 0 < self.whole_corpus_share <= 1:
            raise ValueError("whole_corpus_share must be above 0 and at most 1")

    @property
    def embed_signature(self) -> str:
        """Of the vectors in an index: files indexed with another one are indexed again."""
        return f"{self.embed_provider}_{self.embed_model}_{self.embed_revision or 'unpin'}"

    def top_k(self, degraded: bool) -> int:
        return min(2 * self.retrieval_top_k, self.degraded_top_k) if degraded else self.retrieval_top_k
