"""C4: the declarative stage plan.

A plan says which stages run (embedding upstream or given, exact or cell
pruned search, payload mode, 0-3 rerank passes) and on which side, generation or
gateway, sentiment and toxicity are judged.  The side decides the order:
the generation side judges the plain answer and masks it, the gateway judges
what it is handed, so sentiment at the gateway reads a masked answer when
toxicity was judged before.  Placement on machines is Spark's job.
"""

from __future__ import annotations

from dataclasses import dataclass

from larkspur.constants import (CONTEXT_CHARS, CONTEXT_DOCS, EMBED_DIM, NLIST, NPROBE, TOP_K,
                                TOXIC_THRESHOLD, TRUNCATE_CHARS)

STAGES = ("validate", "embed", "search", "fetch", "truncate", "rerank", "generate",
          "sentiment", "toxicity", "mask", "defaults")
SIDES = ("generation", "gateway")
PAYLOAD_MODES = ("full", "id_only", "compressed")


@dataclass
class AnswerPlan:
    name: str = "answer"
    stages: tuple[str, ...] = STAGES
    k: int = TOP_K
    search: str = "exact"            # "exact" | "ivf"
    nprobe: int = NPROBE
    nlist: int = NLIST
    embed_dim: int = EMBED_DIM
    payload_mode: str = "full"
    truncate_chars: int = TRUNCATE_CHARS
    rerank_passes: int = 1           # 0..3; each pass scores what the one before kept
    rerank_top_n: int | tuple[int | None, ...] | None = None   # kept by the last pass, or by each
    context_docs: int = CONTEXT_DOCS
    context_chars: int = CONTEXT_CHARS
    sentiment_at: str = "generation"     # "generation" | "gateway"
    toxicity_at: str = "generation"
    toxic_threshold: float = TOXIC_THRESHOLD
    has_document_table: bool = True

    def validate(self) -> "AnswerPlan":
        unknown = [s for s in self.stages if s not in STAGES]
        if unknown:
            raise ValueError(f"unknown stage(s): {unknown}")
        if len(set(self.stages)) != len(self.stages):
            raise ValueError("duplicate stage names in plan")
        if self.payload_mode not in PAYLOAD_MODES:
            raise ValueError(f"unknown payload mode {self.payload_mode!r}")
        if self.payload_mode == "id_only" and not self.has_document_table:
            raise ValueError("id_only payloads need a document table to fetch from")
        if not 0 <= self.rerank_passes <= 3:
            raise ValueError("rerank_passes must be between 0 and 3")
        if self.search not in ("exact", "ivf"):
            raise ValueError(f"unknown search {self.search!r}")
        if isinstance(self.rerank_top_n, tuple) and len(self.rerank_top_n) != self.rerank_passes:
            raise ValueError("rerank_top_n must name what each pass keeps")
        for side in (self.sentiment_at, self.toxicity_at):
            if side not in SIDES:
                raise ValueError(f"unknown side {side!r}")
        return self

    def runs(self, stage: str) -> bool:
        if stage == "rerank":
            return "rerank" in self.stages and self.rerank_passes > 0
        return stage in self.stages

    def kept_per_pass(self) -> tuple[int | None, ...]:
        """Documents each rerank pass keeps (None: all)."""
        if isinstance(self.rerank_top_n, tuple):
            return self.rerank_top_n
        return (None,) * (self.rerank_passes - 1) + (self.rerank_top_n,) * min(1, self.rerank_passes)

    def judged_at(self, side: str) -> list[str]:
        """What a side judges, in order."""
        return [s for s, at in (("sentiment", self.sentiment_at), ("toxicity", self.toxicity_at))
                if self.runs(s) and at == side]
