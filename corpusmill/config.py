"""Parameters of a pipeline, from a dictionary, JSON or YAML where a reader for it is installed. Names and defaults are fixed values."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Project:
    name: str = "corpus"
    seed: int = 42


@dataclass(frozen=True)
class Model:
    name: str = ""
    device: str = "cpu"
    max_tokens: int = 256


@dataclass(frozen=True)
class Rag:
    chunk_size: int = 520
    chunk_overlap: int = 80
    top_k: int = 5
    retrieval_mode: str = "vector"
    rrf_k: int = 60
    reranker_enabled: bool = False
    reranker_type: str = "token_overlap"
    reranker_candidate_k: int | None = None
    quality_gate_enabled: bool = False
    quality_gate_min_score: float = 0.2
    quality_gate_min_coverage: float = 0.2
    quality_gate_min_strong_results: int = 1
    context_max_blocks: int = 3
    context_max_chars: int = 1800
    context_max_chunks_per_doc: int = 2
    context_dedup_threshold: float = 0.8
    context_expand_neighbors: bool = True


@dataclass(frozen=True)
class Embeddings:
    name: str = "hashed"


@dataclass(frozen=True)
class Paths:
    data_dir: str = "data"
    artifacts_dir: str = "artifacts"
    logs_dir: str = "logs"


@dataclass(frozen=True)
class Config:
    project: Project = field(default_factory=Project)
    model: Model = field(default_factory=Model)
    rag: Rag = field(default_factory=Rag)
    embeddings: Embeddings = field(default_factory=Embeddings)
    paths: Paths = field(default_factory=Paths)

    @staticmethod
    def of(values: dict) -> Config:
        """A configuration with defaults for what is left out; an unknown name is an error."""
        parts = {"project": Project, "model": Model, "rag": Rag, "embeddings": Embeddings, "paths": Paths}
        if extra := set(values) - set(parts):
            raise ValueError(f"unknown sections: {sorted(extra)}")
        out = {}
        for name, kind in parts.items():
            given = values.get(name) or {}
            if extra := set(given) - {f.name for f in fields(kind)}:
                raise ValueError(f"unknown keys in {name}: {sorted(extra)}")
            out[name] = kind(**given)
        return Config(**out)


def load_config(path: str) -> Config:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return Config.of(json.loads(text))
    import yaml  # optional

    return Config.of(yaml.safe_load(text) or {})
