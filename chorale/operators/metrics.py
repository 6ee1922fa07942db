"""Run summaries, speed and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import exact


def run_summary(runs: DataFrame, *keys: str, time: str = "separation_time", ended: str = "finished_at") -> DataFrame:
    """Per key (or over all): processed, failed, total and mean seconds of successes, seconds from first to last end.

    The mean of no success is NULL.
    """
    ok = F.col("error").isNull()
    total = F.sum(F.when(ok, exact(F.col(time))))
    n = F.count_if(ok)
    span = F.max(ended).cast("timestamp").cast("bigint") - F.min(ended).cast("timestamp").cast("bigint")
    return runs.groupBy(*keys).agg(
        n.alias("processed"), F.count_if(~ok).alias("failed"), total.cast("double").alias("total_time"),
        F.round(F.try_divide(total.cast("double"), F.when(n > 0, n)), 6).alias("mean_time"), span.alias("elapsed_s"),
    )


def realtime_factor(timed: DataFrame, *keys: str, audio: str = "duration_s", time: str = "processing_s") -> DataFrame:
    """Files, mean seconds a file and seconds of audio per second of work, over files with both known."""
    both = timed.where(F.col(audio).isNotNull() & F.col(time).isNotNull())
    a, t = F.sum(exact(F.col(audio))).cast("double"), F.sum(exact(F.col(time))).cast("double")
    return both.groupBy(*keys).agg(F.count("*").alias("files"), F.round(F.try_divide(t, F.count("*")), 6).alias("mean_s"), F.round(F.try_divide(a, t), 4).alias("realtime"))


def shares(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Count and percentage of each value."""
    counts = df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # one row on one side; the counts are already reduced to one row a value
    return counts.join(F.broadcast(total)).select(name, "n", F.round(F.col("n") * 100.0 / F.col("total"), 4).alias("percent"))
