"""Settings of the retrieval pipeline."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    max_chars: int = 800
    overlap: int = 100
    k_sem: int = 4
    k_bm25: int = 4
    final_k: int = 4
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    seed: int = 42
    oracles: int = 150
    distractors: int = 3
    snippet_chars: int = 220
    dims: int = 64
    model: str = "extractive"
    base_url: str = "http://127.0.0.1:1234/v1"
    temperature: float = 0.0
    max_tokens: int = 160

    @classmethod
    def from_env(cls, environ=None) -> Settings:
        """Model, address and temperature may come from the environment."""
        environ = os.environ if environ is None else environ
        return cls(
            model=environ.get("QUARRY_MODEL", cls.model).strip(),
            base_url=environ.get("QUARRY_BASE_URL", cls.base_url),
            temperature=float(environ.get("QUARRY_TEMPERATURE", cls.temperature)),
        )


DEFAULT = Settings()
