"""Readers of the project's tables, and the expressions that every query on them shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Times beyond this many seconds can't be held exactly in hundredths; such values count as missing.
MAX_SECONDS = 9e13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of ``placed`` that tell any two rows of a table apart.
PLACE = ("at_time", "at_file", "at_row")


def placed(df: DataFrame, time: str, *cols: str) -> DataFrame:
    """Chosen columns of a table as it was read, with the place of each row: a time, its file and its number there."""
    return df.select(*cols, F.col(time).alias("at_time"), F.col("_metadata.file_path").alias("at_file"), F.col("_metadata.row_index").alias("at_row"))


def hundredths(seconds: Column) -> Column:
    """Seconds as BIGINT hundredths, halves away from zero; NaN, infinite and absurd values are NULL."""
    return F.when(F.abs(seconds) < MAX_SECONDS, F.round(seconds * 100, 0).cast("bigint"))


def sound_spans(segments: Column) -> Column:
    """The sound segments as ARRAY<STRUCT<s, e>> in hundredths: both bounds known and end > start.

    A NULL array gives an empty one, NULL elements are dropped, order and repeats are kept. The two
    fields are named outside a lambda, so that the scan reads them and not the texts.
    """
    spans = F.zip_with(segments["start"], segments["end"], lambda a, b: F.struct(hundredths(a).alias("s"), hundredths(b).alias("e")))
    kept = F.filter(spans, lambda x: x["e"] > x["s"])
    return F.coalesce(kept, F.array().cast("array<struct<s:bigint,e:bigint>>"))
