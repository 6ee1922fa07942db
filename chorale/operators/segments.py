"""Projections, joins and cuts of segment arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import clock


def from_fields(segments: Column) -> Column:
    """Segments from structs that have more fields: text, start and end are kept, in order."""
    return F.transform(segments, lambda s: F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end")))


def from_pairs(chunks: Column) -> Column:
    """Segments from structs of a text and a ``timestamp`` array of start and end; an open end is NULL."""
    return F.transform(chunks, lambda c: F.struct(c["text"].alias("text"), F.get(c["timestamp"], F.lit(0)).alias("start"), F.get(c["timestamp"], F.lit(1)).alias("end")))


def to_pairs(segments: Column) -> Column:
    return F.transform(segments, lambda s: F.struct(s["text"].alias("text"), F.array(s["start"], s["end"]).alias("timestamp")))


def joined_text(segments: Column) -> Column:
    """Texts joined by one space, untrimmed; an empty array gives an empty text, NULL texts are skipped."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), " ")


def flattened(df: DataFrame, *keys: str) -> DataFrame:
    """One row per segment: keys, seg_no (from 0), text, start, end."""
    one = df.select(*keys, F.posexplode("segments").alias("p", "s"))
    return one.select(*keys, F.col("p").cast("bigint").alias("seg_no"), F.col("s.text").alias("text"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def bounds(df: DataFrame, *keys: str) -> DataFrame:
    """One row per segment without its text, which isn't read: keys, seg_no (from 0), start, end."""
    one = df.select(*keys, F.posexplode(F.arrays_zip(F.col("segments.start"), F.col("segments.end"))).alias("p", "s"))
    return one.select(*keys, F.col("p").cast("bigint").alias("seg_no"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def rebuilt(flat: DataFrame, *keys: str) -> DataFrame:
    """The arrays behind ``flattened``, in order."""
    parts = flat.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seg_no", "text", "start", "end"))).alias("p"))
    return parts.select(*keys, from_fields(F.col("p")).alias("segments"))


def has_open_segment(segments: Column) -> Column:
    """Whether any segment lacks a bound; such records aren't valid."""
    return F.coalesce(F.exists(segments, lambda s: s["start"].isNull() | s["end"].isNull()), F.lit(False))


def chunk_no(start: Column, seconds: int = 30) -> Column:
    """Number of the fixed window of a file in which a segment starts."""
    return F.floor(start / seconds).cast("bigint")


def report_lines(df: DataFrame, *keys: str) -> DataFrame:
    """Console lines of segments, in order: keys, seg_no, line."""
    flat = flattened(df, *keys)
    return flat.select(*keys, "seg_no", F.concat(F.lit("["), clock(F.col("start")), F.lit(" -> "), clock(F.col("end")), F.lit("] "), F.col("text")).alias("line"))
