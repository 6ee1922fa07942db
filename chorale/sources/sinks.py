"""Sinks that may be run again: idempotent appends, record export and atomic audio files."""

from __future__ import annotations

import os
import uuid
import wave
from collections.abc import Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RECORD

#: What makes a result the same piece of work.
KEY = ("path", "model_name", "whisper_implementation")
#: Partitions up to which an append reads only those that it writes to.
MAX_TOUCHED = 500


def stored(like: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, or an empty one of the same columns before the first write."""
    spark = like.sparkSession
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], like.schema)


def append_once(df: DataFrame, path: str, key: Sequence[str] = KEY, partition_by: Sequence[str] = ("model_name", "whisper_implementation"), key_decides: bool = False) -> None:
    """Appends the rows whose key isn't stored yet; a rerun adds nothing. One row per key is kept.

    Partitioned by few-valued columns, never by recording, which would make a folder per recording. Where
    they are part of the key, or follow from it (``key_decides``), keys are read from the partitions that
    the new rows go to and from no others, so what an append reads doesn't grow with the table's age.
    """
    table = stored(df, path)
    if key_decides or set(partition_by) <= set(key):
        touched = df.select(*partition_by).distinct().limit(MAX_TOUCHED + 1).collect()
        if len(touched) <= MAX_TOUCHED:
            some = F.lit(False)
            for row in touched:
                every = F.lit(True)
                for c in partition_by:
                    every = every & table[c].eqNullSafe(F.lit(row[c]))
                some = some | every
            table = table.where(some)
    old = table.select(*key)
    same = [df[k].eqNullSafe(old[k]) for k in key]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    new = df.join(old, cond, "left_anti")
    new.dropDuplicates(list(key)).write.mode("append").partitionBy(*partition_by).parquet(path)


def record_json(df: DataFrame, identity: Sequence[str] = ()) -> DataFrame:
    """One JSON object per record, nulls written out; of its identity only the columns named, in front."""
    fields = [F.col(c) for c in (*identity, *RECORD.names)]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def export_jsonl(df: DataFrame, path: str, identity: Sequence[str] = (), by_recording: bool = False) -> None:
    """Records as JSON lines; failed rows have no record and stay out.

    ``identity=("isrc", "path")`` lets a line be led back to its file; ``by_recording`` writes a folder
    ``isrc=...`` a recording, for corpora of a size where that many folders are wanted.
    """
    done = df.where("error IS NULL")
    if by_recording:
        lines = done.select("isrc", F.to_json(F.struct(*identity, *RECORD.names), {"ignoreNullFields": "false"}).alias("value"))
        lines.repartition("isrc").write.mode("overwrite").partitionBy("isrc").text(path)
    else:
        record_json(done, identity).write.mode("overwrite").text(path)


def write_wav(path: str, samples: np.ndarray, rate: int) -> int:
    """16-bit PCM; written aside and renamed, so a task that is run again never leaves half a file."""
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    x = samples if samples.ndim == 2 else samples[:, None]
    with wave.open(aside, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1 - 2**-15) * 32768).round().astype("<i2").tobytes())
    os.replace(aside, path)
    return os.path.getsize(path)
