"""Batch speech-transcription analytics on Spark: sources, backends, operators and query plans."""

__version__ = "0.1.0"
