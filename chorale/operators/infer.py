"""Runs a backend over a table of files, with one row out for every row in.

Filters, projections and the anti-join with finished work belong before these calls, because Spark
can't push anything through them.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import backends
from ..functions.paths import audio_type_of, isrc_of
from ..schema import RESULT, SEPARATION
from ..sources.audio import decode as read_wav
from ..sources.audio import resampled
from ..sources.sinks import write_wav


def spread(df: DataFrame, tasks: int) -> DataFrame:
    """Files over tasks by a hash of the path: a file source packs many small files into one task."""
    return df.repartition(tasks, F.xxhash64("path"))


def transcribe(df: DataFrame, backend: str, model: str, options: backends.Options | None = None, content: Column | None = None, run_id: str | None = None, tasks: int | None = None) -> DataFrame:
    """Records of the files in ``df`` (a ``path`` column); ``content`` is what is handed on beside the path.

    A failing file gives a row with NULL record fields and the error; a model that can't be loaded
    ends the run. The time covers the backend's call with its decoding, not the model's loading.
    ``whisper_implementation`` is the backend's name. A segment without an end is an error, as the
    record requires one.
    """
    given = options or backends.Options()
    made = backends.create(backend)
    settings = given.chosen(made.options, set(given.extra))
    src = df.select("path", (content if content is not None else F.lit(None).cast("string")).alias("content"), audio_type_of(F.col("path")).alias("audio_type"), isrc_of(F.col("path")).alias("isrc"))
    src = spread(src, tasks) if tasks else src

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = backends.create(backend)
        worker.load(model, **settings)
        for pdf in frames:
            rows: list[dict[str, Any]] = []
            for path, body, kind, isrc in pdf.itertuples(index=False):
                row: dict[str, Any] = dict.fromkeys(RESULT.names)
                row |= {"run_id": run_id, "isrc": isrc, "path": path, "model_name": model, "whisper_implementation": worker.name, "audio_type": kind}
                try:
                    began = time.perf_counter()
                    got = worker.transcribe(path, body)
                    took = time.perf_counter() - began
                    parts = [{"text": str(s["text"]), "start": float(s["start"]), "end": float(s["end"])} for s in got["segments"]]
                    row |= {"full_text": got["full_text"], "segments": parts, "detected_language": got["detected_language"], "alignment_model_load_time": got.get("alignment_model_load_time"), "transcription_time": took}
                except Exception as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=RESULT.names).astype({"alignment_model_load_time": "Float64", "transcription_time": "Float64"})

    return src.mapInPandas(run, RESULT)


def separate(df: DataFrame, backend: str, model: str, output: str, rate: int | None = None, tasks: int | None = None) -> DataFrame:
    """Writes the vocals of every file (``path``) beside it as ``output``; one row a file.

    The backend decodes the file, at its model's own rate if it has one (else at ``rate``, or the file's),
    and the vocals are written at the rate that went in. The time covers the separation only. Files are
    replaced in one step, so tasks may run twice.
    """
    src = df.select("path", isrc_of(F.col("path")).alias("isrc"))
    src = spread(src, tasks) if tasks else src

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = backends.create(backend)
        worker.load(model)
        for pdf in frames:
            rows: list[dict[str, Any]] = []
            for path, isrc in pdf.itertuples(index=False):
                plain = path.removeprefix("file:")
                target = os.path.join(os.path.dirname(plain), output)
                row: dict[str, Any] = {"isrc": isrc, "path": path, "output_path": target, "bytes": None, "separation_time": None, "error": None}
                try:
                    want = worker.rate or rate
                    samples, have = worker.decode(plain, want)
                    if want and have != want:
                        samples, have = resampled(samples, have, want), want
                    began = time.perf_counter()
                    vocals = worker.separate(samples, have)["vocals"]
                    took = time.perf_counter() - began
                    row |= {"bytes": write_wav(target, vocals, have), "separation_time": took}
                except Exception as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=SEPARATION.names).astype({"bytes": "Int64", "separation_time": "Float64"})

    return src.mapInPandas(run, SEPARATION)


def decoded(df: DataFrame) -> DataFrame:
    """What is in the WAV files (``path``): isrc, frames, channels, rate, sum of the first channel's 16-bit samples."""
    src = df.select(isrc_of(F.col("path")).alias("isrc"), "path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for isrc, path in pdf.itertuples(index=False):
                x, rate = read_wav(path.removeprefix("file:"))
                rows.append((isrc, len(x), x.shape[1], rate, int((x[:, 0] * 32768).round().sum())))
            yield pd.DataFrame(rows, columns=["isrc", "frames", "channels", "rate", "total"])

    return src.mapInPandas(run, "isrc string, frames bigint, channels bigint, rate bigint, total bigint")


def failures(results: DataFrame) -> DataFrame:
    return results.where("error IS NOT NULL")


def successes(results: DataFrame) -> DataFrame:
    return results.where("error IS NULL")
