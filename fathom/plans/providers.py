"""Who answers a prompt: nobody by default, or a stand-in for tests. Answers are asked for on the driver, one packet at a time."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Protocol


@dataclass(frozen=True)
class Answer:
    text: str
    provider: str
    model: str


class Provider(Protocol):
    name: str

    def answer(self, prompt: str) -> Answer: ...


@dataclass(frozen=True)
class FakeProvider:
    """The same answer to everything."""

    text: str = "No model was asked."
    name: str = "fake"

    def answer(self, prompt: str) -> Answer:
        return Answer(self.text, self.name, "fake")


def load_provider(env: Mapping[str, str] | None = None) -> Provider | None:
    """The provider that FATHOM_LLM_PROVIDER names: none (also unset or blank) or fake; ValueError for others."""
    name = (os.environ if env is None else env).get("FATHOM_LLM_PROVIDER", "").strip().lower()
    if name in ("", "none"):
        return None
    if name == "fake":
        return FakeProvider()
    raise ValueError(f"unknown provider: {name}")


def ask(provider: Provider | None, prompt: str) -> dict[str, str]:
    """completed with an answer, skipped without a provider, error with the kind of what went wrong."""
    if provider is None:
        return {"status": "skipped"}
    try:
        a = provider.answer(prompt)
        return {"status": "completed", "text": a.text, "provider": a.provider, "model": a.model}
    except Exception as e:  # whatever a provider raises must not end a diagnosis
        return {"status": "error", "message": type(e).__name__}
