"""Deterministic stand-ins without models, for tests and for queries over text tables."""

from __future__ import annotations

from typing import Any

import numpy as np

from ..sources.audio import decode
from .base import register

CHARS_PER_SECOND = 15


@register("stub")
class StubBackend:
    """Takes the content as the words sung: one segment a line, fifteen characters a second."""

    name, options = "stub", ("language",)

    def load(self, model: str, language: str = "en") -> None:
        self.language = language

    def transcribe(self, path: str, content: Any) -> dict[str, Any]:
        if content is None or content == "":
            raise ValueError("no content")
        text = content.decode("utf-8", "replace") if isinstance(content, bytes) else content
        segments, done = [], 0
        for line in text.split("\n"):
            segments.append({"text": line, "start": done / CHARS_PER_SECOND, "end": (done + len(line)) / CHARS_PER_SECOND})
            done += len(line)
        return {"full_text": " ".join(s["text"] for s in segments), "segments": segments, "detected_language": self.language}


@register("stub-separator")
class StubSeparator:
    """The mean of the channels as vocals, the rest as accompaniment."""

    name, options, rate = "stub-separator", (), None

    def load(self, model: str) -> None:
        pass

    def decode(self, path: str, rate: int | None) -> tuple[np.ndarray, int]:
        return decode(path, rate)

    def separate(self, samples: np.ndarray, rate: int) -> dict[str, np.ndarray]:
        vocals = samples.mean(1, keepdims=True).repeat(samples.shape[1], 1)
        return {"vocals": vocals, "accompaniment": samples - vocals}
