"""Models by kind and name: functions of a batch, registered by whoever has them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

# Kinds of models.
KINDS = ["chat", "embedding", "rerank", "cv", "ocr", "tts", "asr"]


@dataclass
class Models:
    """A registry, passed to where models are chosen by name; nothing is global."""

    known: dict[tuple[str, str], Callable] = field(default_factory=dict)

    def add(self, kind: str, name: str, model: Callable) -> Callable:
        if kind not in KINDS:
            raise ValueError(f"unknown kind of model: {kind}")
        self.known[kind, name] = model
        return model

    def get(self, kind: str, name: str) -> Callable:
        if (kind, name) not in self.known:
            raise KeyError(f"no {kind} model {name}; there are {self.names(kind)}")
        return self.known[kind, name]

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self.known if k == kind)

    def of_kind(self, kind: str) -> dict[str, Callable]:
        """All of a kind, as ``rerank_by`` takes them."""
        return {n: self.known[kind, n] for n in self.names(kind)}
