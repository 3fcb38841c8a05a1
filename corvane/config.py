"""Settings of a retrieval pipeline."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class RetrievalConfig:
    """One arm's settings.

    retrieval: dense, sparse or hybrid; rerank: always, never, auto or llm; mode:
    plain, crag (the corrective loop) or agent (with tools); grader: threshold or
    llm; loop: plain or graph, two drivers of the same steps.
    """

    retrieval: str = "dense"
    rerank: str = "never"
    use_reranker: bool = False
    k: int = 5
    rerank_candidates: int = 20
    rrf_k: int = 60
    chunk_size: int = 512
    chunk_overlap: int = 64
    embedder: str = "hash64"
    auto_top: float = 0.55
    auto_margin: float = 0.05
    scored_relevant: float = 0.0
    scored_incorrect: float = -4.0
    cosine_relevant: float = 0.45
    cosine_incorrect: float = 0.25
    refusal_cosine: float = 0.35
    correction_rounds: int = 2
    widen_factor: int = 2
    relax_step: float = 0.1
    reformulate: bool = True
    grader: str = "threshold"
    loop: str = "graph"
    tool_steps: int = 6
    mode: str = "plain"

    def __post_init__(self) -> None:
        known = {"retrieval": ("dense", "sparse", "hybrid"), "rerank": ("always", "never", "auto", "llm"), "mode": ("plain", "crag", "agent"), "grader": ("threshold", "llm"), "loop": ("plain", "graph")}
        for name, values in known.items():
            if getattr(self, name) not in values:
                raise ValueError(f"unknown {name} {getattr(self, name)!r}")

    @property
    def policy(self) -> str:
        """The rerank policy; use_reranker is an older way to say always, heard only where the policy is never."""
        return "always" if self.use_reranker and self.rerank == "never" else self.rerank

    @property
    def depth(self) -> int:
        """Candidates of the first stage: as many as are asked for, more where they may be reranked."""
        return self.k if self.policy == "never" else max(self.rerank_candidates, self.k)

    @property
    def deepest(self) -> int:
        """Candidates of the corrective loop's last round, were it only to widen."""
        return self.rerank_candidates * self.widen_factor**self.correction_rounds

    @property
    def tag(self) -> str:
        """Names artifacts: chunk size and overlap, and the embedder, so that another embedder never meets old vectors."""
        return f"cs{self.chunk_size}_co{self.chunk_overlap}_{self.embedder}"

    def with_(self, **changes: object) -> RetrievalConfig:
        return replace(self, **changes)
