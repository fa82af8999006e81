"""Settings: defaults, overridden by the first readable JSON file."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from pathlib import Path

from strandwork.operators.fusion import Weights, weights


@dataclass(frozen=True)
class Settings:
    """The defaults of the pipeline."""

    chunk_words: int = 220
    chunk_overlap: int = 40
    dimensions: int = 256
    fts_k: int = 12
    vector_k: int = 20
    top_k: int = 3
    word_budget: int = 150
    relevance_floor: float = 0.15
    min_fts_hits: int = 3
    use_rrf: bool = True
    cache_ttl: int = 900
    weights: Weights = Weights()


_NAMES = {"chunkSizeWords": "chunk_words", "chunkOverlapWords": "chunk_overlap", "topK": "top_k", "wordBudget": "word_budget", "relevanceFloor": "relevance_floor", "ftsK": "fts_k"}


def load(*paths: str) -> Settings:
    """Wrong types, booleans for numbers and a top_k below 1 leave the default; an object "weights" takes the place of weights by name."""
    out = Settings()
    for p in paths:
        try:
            data = json.loads(Path(p).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            continue
        if not isinstance(data, dict):
            continue
        data = data.get("tokenReducer", data)
        for name, field in _NAMES.items():
            value = data.get(name) if isinstance(data, dict) else None
            if isinstance(value, bool) or not isinstance(value, (int, float)) or field == "top_k" and value < 1:
                continue
            out = replace(out, **{field: type(getattr(out, field))(value)})
        if isinstance(data, dict) and isinstance(data.get("weights"), dict):
            out = replace(out, weights=weights(data["weights"]))
        break
    return out
