"""Transcription and separation backends behind one contract."""

from . import adapters, stub  # noqa: F401  (they register themselves)
from .base import Options, create, known, register

__all__ = ["Options", "create", "known", "register"]
