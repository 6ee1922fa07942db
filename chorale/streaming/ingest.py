"""Incremental ingest of new files and new rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import audio_type_of, isrc_of
from ..sources.audio import FILES
from ..sources.sinks import append_once


def new_audio(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the audio files under the root that earlier runs haven't seen; bytes are not read."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.{wav,mp3}").load(f"{root}/*")
    return files.select(isrc_of(F.col("path")).alias("isrc"), "path", audio_type_of(F.col("path")).alias("audio_type"), F.col("modificationTime").alias("modification_time"), "length")


def new_rows(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the rows in Parquet files that arrive under ``path``; a path that is one file gives that file."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if single:  # a stream reads folders only
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def ingest(stream: DataFrame, target: str, checkpoint: str, key: Sequence[str], partition_by: Sequence[str], key_decides: bool = True) -> int:
    """Takes in all that is there now, once per key, and ends; returns the number of batches.

    A batch that is run again after a failure adds nothing twice, because the sink knows the keys. As a key's
    repeats have the same partition (``key_decides``), a batch reads the keys of the partitions that it goes to.
    """
    query = (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, _: append_once(batch, target, key, partition_by, key_decides))
        .start()
    )
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"]])


def daily_counts(stream: DataFrame, key: str, time: str, late: str, *groups: str) -> DataFrame:
    """Rows per day and group of a stream, each key once: repeats within the allowed lateness are dropped.

    State is kept for as long as the watermark allows and no longer; a day is given out when it can't change.
    """
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return once.groupBy(F.window(time, "1 day").alias("day"), *groups).agg(F.count("*").alias("n"))
