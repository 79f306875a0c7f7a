"""Parameters that have to be right before anything runs; values are passed in, nothing is read from files here."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

#: What may be chosen, and the dimensions that one of the services gives.
PROVIDERS = ("gemini", "ollama")
THINKING_LEVELS = ("minimal", "low", "medium", "high")


def required(values: Mapping[str, str], name: str) -> str:
    """A value that must be there and not blank."""
    found = (values.get(name) or "").strip()
    if not found:
        raise ValueError(f"{name} is missing")
    return found


def choice(values: Mapping[str, str], name: str, allowed: tuple[str, ...], default: str) -> str:
    found = (values.get(name) or default).strip().lower()
    if found not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return found


def number(values: Mapping[str, str], name: str, default: int, least: int = 1) -> int:
    """A whole number of at least ``least``."""
    try:
        found = int((values.get(name) or "").strip() or default)
    except ValueError:
        raise ValueError(f"{name} must be a whole number") from None
    if found < least:
        raise ValueError(f"{name} must be at least {least}")
    return found


def resolved(root: str, path: str) -> str:
    """A path below the project's root, unless it is absolute or a URI."""
    return path if os.path.isabs(path) or "://" in path else os.path.join(root, path)


@dataclass(frozen=True)
class Settings:
    """Settings of retrieval and answering, checked once."""

    provider: str
    embedding_model: str
    dimension: int
    index: str
    top_k: int
    pool: int
    per_source: int
    thinking: str
    output_tokens: int

    @classmethod
    def of(cls, values: Mapping[str, str], root: str) -> Settings:
        provider = choice(values, "EMBEDDING_PROVIDER", PROVIDERS, "gemini")
        default = {"ollama": "nomic-embed-text", "gemini": "gemini-embedding-001"}[provider]
        return cls(
            provider, (values.get("EMBEDDING_MODEL") or default).strip(), number(values, "EMBEDDING_DIM", 768),
            resolved(root, (values.get("RAG_INDEX_DIR") or "corpus/processed/index").strip()), number(values, "RAG_TOP_K", 3),
            number(values, "RAG_CANDIDATE_K", 10), number(values, "MAX_CHUNKS_PER_SOURCE", 1),
            choice(values, "GEMINI_THINKING_LEVEL", THINKING_LEVELS, "minimal"), number(values, "GENERATION_MAX_OUTPUT_TOKENS", 700),
        )
