"""Clock format and timing measures, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column) -> Column:
    """``H:MM:SS`` of whole seconds, truncated; from 24 hours on ``D day(s), H:MM:SS``."""
    s = F.floor(seconds).cast("bigint")
    days, rest = F.floor(s / 86400).cast("bigint"), F.pmod(s, F.lit(86400))
    hms = F.format_string("%d:%02d:%02d", F.floor(rest / 3600).cast("bigint"), F.floor(F.pmod(rest, F.lit(3600)) / 60).cast("bigint"), F.pmod(rest, F.lit(60)))
    return F.when(days == 0, hms).when(days == 1, F.concat(F.lit("1 day, "), hms)).otherwise(F.concat(days.cast("string"), F.lit(" days, "), hms))


def alignment_share(alignment: Column, total: Column) -> Column:
    """Percent of the time spent on loading the alignment model; NULL if either is missing or total is 0."""
    return F.try_divide(alignment, total) * 100


def without_alignment(alignment: Column, total: Column) -> Column:
    return total - alignment


def two_decimals(value: Column) -> Column:
    """For display only."""
    return F.format_string("%.2f", value)


def exact(value: Column) -> Column:
    """A DOUBLE as DECIMAL, so that sums don't depend on the order of partitions."""
    return value.cast("decimal(24,6)")
