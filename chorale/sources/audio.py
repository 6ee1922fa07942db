"""Audio files as tables: one folder of a corpus root per recording."""

from __future__ import annotations

import io
import os
import re
import wave
from math import gcd
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import audio_type_of, isrc_of

EXTENSIONS = ("wav", "mp3")
#: Columns of Spark's reader of whole files.
FILES = "path string, modificationTime timestamp, length bigint, content binary"
MAX_PHASES = 4096


def _literal(path: str) -> str:
    """The path with what a glob would take for a pattern escaped."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path.rstrip("/"))


def _directory(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path, which must be a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        raise FileNotFoundError(path)
    return fs, at


def audio_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, strict: bool = False, content: bool = False) -> DataFrame:
    """Audio one level below ``root``: isrc, path, audio_type, modification_time, length.

    Files in the root itself or nested deeper are no recordings; dotfiles, suffixes in another case and
    files without a byte are skipped. No match gives no rows; a missing root raises. The bytes are read
    only with ``content=True``; backends that open the path themselves don't need them. The driver lists
    the root alone, and the folders in it are listed by Spark's tasks.
    """
    fs, at = _directory(spark, root)
    depth = fs.makeQualified(at).toString().rstrip("/").count("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    try:
        every = reader.load(f"{_literal(root)}/[^._]*").where(F.size(F.split("path", "/")) == depth + 3)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        every = spark.createDataFrame([], FILES)
    return every.select(isrc_of(F.col("path")).alias("isrc"), "path", audio_type_of(F.col("path"), strict).alias("audio_type"), F.col("modificationTime").alias("modification_time"), "length", *(["content"] if content else []))


def single_file(spark: SparkSession, path: str) -> DataFrame:
    """One file of any extension, as ``audio_files`` gives it; no rows if it is missing."""
    df = spark.createDataFrame([(path,)] if os.path.exists(path) else [], "path string")
    return df.select(isrc_of(F.col("path")).alias("isrc"), "path", audio_type_of(F.col("path")).alias("audio_type"))


def folders(spark: SparkSession, root: str) -> DataFrame:
    """Direct child folders of the root: isrc. The listing is one directory of any file system."""
    fs, at = _directory(spark, root)
    found, names = fs.listStatusIterator(at), []
    while found.hasNext():
        f = found.next()
        if f.isDirectory():
            names.append((f.getPath().getName(),))
    return spark.createDataFrame(sorted(names), "isrc string")


def folders_without_audio(folder: DataFrame, files: DataFrame) -> DataFrame:
    return folder.select("isrc").distinct().join(files.select("isrc").distinct(), "isrc", "left_anti")


def resampled(x: np.ndarray, have: int, want: int, taps: int = 32) -> np.ndarray:
    """Samples (frames, channels) at another rate, by a windowed sinc that keeps what both rates can hold."""
    if have == want or not len(x):
        return x
    n = len(x) * want // have
    phases = min(want // gcd(have, want), MAX_PHASES)  # places between two samples that are told apart
    cut = min(1.0, want / have)
    reach = int(np.ceil(taps / cut))
    t = np.arange(-reach, reach + 1)[None, :] - (np.arange(phases) / phases)[:, None]
    kernel = np.sinc(cut * t) * np.cos(np.clip(t / (reach + 1), -1, 1) * np.pi / 2) ** 2
    kernel = (kernel / kernel.sum(1, keepdims=True)).astype(np.float32)
    padded = np.pad(x.astype(np.float32), ((reach, reach), (0, 0)))
    out = np.empty((n, x.shape[1]), np.float32)
    for a in range(0, n, 1 << 15):
        i = np.arange(a, min(n, a + (1 << 15)))
        at, between = i * have // want, i * have % want
        near = padded[at[:, None] + np.arange(2 * reach + 1)]
        out[i] = np.einsum("ik,ikc->ic", kernel[between * phases // want], near)
    return out


def decode(content: bytes | str, rate: int | None = None) -> tuple[np.ndarray, int]:
    """Samples (frames, channels) in [-1, 1] and their rate, from WAV bytes or a path.

    Whole numbers of 8, 16, 24 and 32 bits; ``rate`` resamples. Other formats are left to backends that
    open the path themselves, and raise here.
    """
    head = content[:12] if isinstance(content, bytes) else open(content, "rb").read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("only WAV can be decoded here; configure a backend that opens the path itself")
    with wave.open(io.BytesIO(content) if isinstance(content, bytes) else content, "rb") as w:
        width, channels, have = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8)[: len(wide) * 3].reshape(-1, 3)
        x = wide.view("<i4")[:, 0].astype(np.float32) / float(1 << 31)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels)
    return (resampled(x, have, rate), rate) if rate else (x, have)
