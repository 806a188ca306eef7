"""One typed configuration with a single source of defaults; each field can be set by an environment variable KB_<NAME>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    max_chunk: int = 2500
    small_chunk: int = 200
    concurrence: int = 5
    seuil_fusion: float = 92.0
    seuil_arbitrage: float = 80.0
    candidats_par_nom: int = 10
    dim_embedding: int = 64
    max_chars_prompt: int = 4500
    max_contexte: int = 6000
    rrf_k: int = 60
    max_noeuds_dossier: int = 600
    max_documents_dossier: int = 200
    max_passages_doc: int = 15
    max_incidents: int = 500
    model: str = "offline-template"
    embedding_model: str = "offline-hashing"
    id_hex: int = 8

    @classmethod
    def from_env(cls, env=os.environ) -> Config:
        """Defaults, with KB_MAX_CHUNK and the like put over them."""
        own = {f.name: type(f.default)(env[f"KB_{f.name.upper()}"]) for f in fields(cls) if f"KB_{f.name.upper()}" in env}
        return cls(**own)
