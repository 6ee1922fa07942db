"""Repairs of repeated deliveries, and the choice of work that is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept


def latest(df: DataFrame, key: str, time: str) -> DataFrame:
    """The row with the latest time of each key; of equal times any. Aggregated, so it combines before the shuffle."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(time)).alias("r")).select(key, "r.*")


#: Rows up to which the keys that occur more than once are broadcast (some 100 bytes each).
BROADCAST_ROWS = 500_000


def once(df: DataFrame, key: str, place: Sequence[str]) -> DataFrame:
    """Each key once: its first row by ``place``, columns that no two rows of a key have alike.

    Keys and places are read first, by themselves; only keys that occur more than once go on. Up to
    ``BROADCAST_ROWS`` of them are broadcast, so nothing wide is shuffled for a few repeats; more are joined
    by a shuffle. A NULL key isn't a key: its rows are all kept.
    """
    at = F.struct(*place)
    many = df.select(F.col(key).alias("k"), at.alias("p")).groupBy("k").agg(F.count("*").alias("n"), F.min("p").alias("p")).where("n > 1 AND k IS NOT NULL").select("k", "p")
    many = kept(many)
    many = F.broadcast(many) if many.count() <= BROADCAST_ROWS else many
    return df.join(many, df[key] == many["k"], "left").where(F.col("p").isNull() | (F.col("p") == at)).drop("k", "p", *place)


def unfinished(work: DataFrame, finished: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``work`` without a finished row of the same key; to be taken before any inference."""
    return work.join(finished.select(*key).distinct(), list(key), "left_anti")
