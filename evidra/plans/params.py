"""Parameters of the two retrieval methods."""

from __future__ import annotations

from dataclasses import dataclass, fields

from evidra.functions.text import OVERLAP, SIZE
from evidra.functions.vectors import DIM


class _Params:
    @classmethod
    def from_dict(cls, given: dict | None):
        """From a partial dictionary; unknown names and nulls are left out."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (given or {}).items() if k in known and v is not None})


@dataclass(frozen=True)
class GraphParams(_Params):
    top_k: int = 6
    seed_limit: int = 3
    hops: int = 1
    legislator_weight: float = 2.0
    committee_weight: float = 1.0
    subject_weight: float = 0.5


@dataclass(frozen=True)
class VectorParams(_Params):
    top_k: int = 6
    chunk_strategy: str = "recursive"
    chunk_size: int = SIZE
    chunk_overlap: int = OVERLAP
    embedder_dim: int = DIM
    similarity_threshold: float = 0.0

    @property
    def is_custom(self) -> bool:
        """Whether stored passages and vectors won't do, so that texts are cut and embedded anew."""
        plain = VectorParams()
        return any(getattr(self, n) != getattr(plain, n) for n in ("chunk_strategy", "chunk_size", "chunk_overlap", "embedder_dim"))
