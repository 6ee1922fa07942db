"""The contract of transcription and separation backends, and their registry."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol


class Backend(Protocol):
    """Made once per task, before its first file; ``load`` may raise, which ends the run."""

    name: str
    options: tuple[str, ...]

    def load(self, model: str, **options: Any) -> None: ...

    def transcribe(self, path: str, content: Any) -> dict[str, Any]:
        """full_text, segments (dicts of text, start, end), detected_language, perhaps alignment_model_load_time."""
        ...


class Separator(Protocol):
    """``rate`` is the rate of the loaded model, which its samples go in and come out at; None takes any."""

    name: str
    options: tuple[str, ...]
    rate: int | None

    def load(self, model: str, **options: Any) -> None: ...

    def decode(self, path: str, rate: int | None) -> tuple[Any, int]:
        """Samples (frames, channels) of a file and their rate; the backend opens the formats that it knows."""
        ...

    def separate(self, samples: Any, rate: int) -> dict[str, Any]:
        """Samples by stem name; 'vocals' is kept."""
        ...


@dataclass
class Options:
    """Settings of a run; every backend takes those that it names and warns of the rest."""

    beam_size: int = 5
    vad: bool = False
    batch_size: int = 16
    extra: dict[str, Any] = field(default_factory=dict)

    def chosen(self, names: tuple[str, ...], given: set[str]) -> dict[str, Any]:
        every = {"beam_size": self.beam_size, "vad": self.vad, "batch_size": self.batch_size, **self.extra}
        unused = sorted(given - set(names))
        if unused:
            warnings.warn(f"options without effect on this backend: {', '.join(unused)}", stacklevel=2)
        return {k: v for k, v in every.items() if k in names}


_registry: dict[str, Callable[[], Any]] = {}


def register(name: str) -> Callable[[Callable[[], Any]], Callable[[], Any]]:
    def add(factory: Callable[[], Any]) -> Callable[[], Any]:
        _registry[name] = factory
        return factory

    return add


def create(name: str) -> Any:
    if name not in _registry:
        raise ValueError(f"unknown backend {name!r}; known: {', '.join(sorted(_registry))}")
    return _registry[name]()


def known() -> list[str]:
    return sorted(_registry)
