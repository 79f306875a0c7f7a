"""Service clients over a transport that is passed in: how a call is written and read, and when it is repeated. The
library opens no connection of its own; tests use a transport that answers from memory."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from quillmesh.operators.embedding import RETRIES, ServiceError, with_retries

#: ``(url, headers, payload, timeout) -> (status, headers, body)``; raises OSError if there is no answer.
Transport = Callable[[str, dict, dict, float], tuple[int, dict, str]]
EMBED_TIMEOUT, ANSWER_TIMEOUT = 120.0, 45.0
#: Services, the tasks as one of them names them, and the model family that wants a prefix.
PROVIDERS = ("gemini", "ollama")
TASKS = {"document": "RETRIEVAL_DOCUMENT", "query": "RETRIEVAL_QUERY"}
PREFIXED = "nomic-embed-text"


def told(body: str, limit: int = 300) -> str:
    """What an error response says, on one line; no request data is in it."""
    try:
        found = json.loads(body)
    except ValueError:
        found = body
    if isinstance(found, dict):
        inner = found.get("error", found.get("message", ""))
        found = inner.get("message", "") if isinstance(inner, dict) else inner
    return " ".join(str(found).split())[:limit]


def post(transport: Transport, url: str, headers: dict, payload: dict, timeout: float, retries: int = RETRIES, sleep=time.sleep) -> dict:
    """The JSON answer of a call; 429, 5xx and broken connections are repeated, after what Retry-After says."""

    def once() -> dict:
        try:
            status, got, body = transport(url, headers, payload, timeout)
        except OSError as e:
            raise ServiceError(f"no answer: {type(e).__name__}", 503) from None
        if not 200 <= status < 300:
            wait = {k.lower(): v for k, v in got.items()}.get("retry-after")
            raise ServiceError(f"HTTP {status}: {told(body)}", status, float(wait) if str(wait or "").strip().isdigit() else None)
        try:
            return json.loads(body)
        except ValueError:
            raise ServiceError("the answer is no JSON", status) from None

    return with_retries(once, retries, sleep=sleep)


def _gemini_call(texts: list[str], task: str, c: EmbeddingClient) -> tuple[str, dict, dict]:
    if not c.key:
        raise ServiceError("a key is needed")
    name = f"models/{c.model}"
    config = {"taskType": TASKS[task], "outputDimensionality": c.dimension}
    requests = [{"model": name, "content": {"parts": [{"text": t}]}, "embedContentConfig": config} for t in texts]
    return f"{c.base_url.rstrip('/')}/{name}:batchEmbedContents", {"x-goog-api-key": c.key}, {"requests": requests}


def _ollama_call(texts: list[str], task: str, c: EmbeddingClient) -> tuple[str, dict, dict]:
    payload = {"model": c.model, "input": texts, "truncate": True, "keep_alive": "30m"}
    return f"{c.base_url.rstrip('/')}/api/embed", {}, payload


_CALLS = {"gemini": _gemini_call, "ollama": _ollama_call}
_VECTORS = {"gemini": lambda x: [v.get("values", []) for v in x.get("embeddings") or []], "ollama": lambda x: x.get("embeddings") or []}
_HINTS = {"ollama": lambda c: f"start the service and pull the model first: ollama pull {c.model}"}


@dataclass(frozen=True)
class EmbeddingClient:
    """An embedder for ``embedding.embed``. The key is in no message and in no repr. Prefixes are the caller's."""

    provider: str
    model: str
    dimension: int
    transport: Transport
    base_url: str
    key: str = field(default="", repr=False)
    retries: int = RETRIES
    timeout: float = EMBED_TIMEOUT
    sleep: Callable[[float], None] = time.sleep

    def __post_init__(self):
        if self.provider.strip().lower() not in PROVIDERS:
            raise ValueError(f"unknown provider {self.provider!r}; one of {PROVIDERS}")
        if self.dimension < 1 or self.timeout <= 0:
            raise ValueError("dimension is at least 1, the timeout above 0")

    def __call__(self, texts: list[str], task: str) -> np.ndarray:
        if not texts or task not in TASKS:
            raise ValueError("there has to be a text, and a task that is document or query")
        name = self.provider.strip().lower()
        url, headers, payload = _CALLS[name](texts, task, self)
        try:
            answer = post(self.transport, url, headers | {"Content-Type": "application/json"}, payload, self.timeout, self.retries, self.sleep)
        except ServiceError as e:
            hint = _HINTS[name](self) if name in _HINTS and e.status in (None, 503) else ""
            raise ServiceError(f"{name} embedding failed: {e}. {hint}".strip(), e.status) from None
        vectors = _VECTORS[name](answer)
        if len(vectors) != len(texts) or any(len(v) != self.dimension for v in vectors):
            raise ServiceError(f"{name} gave another shape than {len(texts)} x {self.dimension}")
        return np.array(vectors, np.float32)


@dataclass(frozen=True)
class GenerationClient:
    """A model for ``embedding.answer``: sends the JSON of ``answering.request``, gives the first candidate's text."""

    model: str
    transport: Transport
    base_url: str
    key: str = field(repr=False)
    retries: int = RETRIES
    timeout: float = ANSWER_TIMEOUT
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, request: str) -> str:
        url = f"{self.base_url.rstrip('/')}/models/{self.model}:generateContent"
        headers = {"Content-Type": "application/json", "x-goog-api-key": self.key}
        answer = post(self.transport, url, headers, json.loads(request), self.timeout, self.retries, self.sleep)
        first = next(iter(answer.get("candidates") or []), {})
        text = "".join(p.get("text", "") for p in (first.get("content") or {}).get("parts") or []).strip()
        if not text:
            raise ServiceError("the model gave no text")
        return text
