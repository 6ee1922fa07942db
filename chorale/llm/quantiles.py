"""Problem 6: percentiles of very large numeric columns, by cumulative frequencies.

Rows are first reduced to counts per group and value, which combine on the map side, so a value
or group that holds a third of all rows costs one row per task. The counts are range-sorted by
group and value over all partitions and kept in the shared folder as a table bucketed by partition;
each partition's totals per group (a few rows) give the offset that its window running sums start from;
the first value whose running count reaches the target rank is the percentile. As partitions are
buckets, neither totals nor running sums shuffle the table again.

The frequency table is the state that combines: tables of days, shards or sources are added value
by value, and percentiles of any period come from the sum. With ``digits=None`` values are exact and
so are the percentiles (nearest rank). With ``digits=d`` values are rounded to d significant digits
before counting, which bounds the table's size and gives a relative error of at most
``0.5 * 10 ** (1 - d)``. Percentiles need no more than partial counts: where the table itself isn't
wanted, ``partial=True`` leaves the counts of each task as they are and saves their shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bucket_keys, kept, kept_in_buckets

NAMES = ("value", "n")
#: Offsets (a row a group and partition) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Rows that a task counts at once.
AT_ONCE = 500_000


def rounded(value: Column, digits: int | None) -> Column:
    """``value`` to so many significant digits; positive finite values only."""
    if digits is None:
        return value
    step = F.pow(F.lit(10.0), F.floor(F.log10(value)) - (digits - 1))
    return F.round(value / step, 0) * step


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (groups, v) as counts per group and value of some batches at a time."""

    def count(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        out = t.group_by(t.column_names).aggregate([([], "count_all")])
        yield from out.rename_columns([*t.column_names, "n"]).combine_chunks().to_batches()

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows >= AT_ONCE:
            yield from count(held)
            held, rows = [], 0
    if rows:
        yield from count(held)


def frequencies(df: DataFrame, groups: Sequence[str], value: Column, digits: int | None = None, names: tuple[str, str] = NAMES, partial: bool = False) -> DataFrame:
    """Counts per group and value: columns ``groups``, then ``names``. Other columns are ignored.

    With ``partial`` a group and value may have several rows whose counts add up: nothing is shuffled.

    NULL, NaN, infinite, zero and negative values are no measurements and left out; a NULL group
    column is a group of its own.
    """
    keys = [f"g{i}" for i in range(len(groups))]
    src = df.select(*[F.col(f"`{g}`").alias(k) for g, k in zip(groups, keys)], value.cast("double").alias("v")).where((F.col("v") > 0) & (F.col("v") < float("inf")))
    src = src.withColumn("v", rounded(F.col("v"), digits))
    if partial:
        counts = src.mapInArrow(_counted, T.StructType([*src.schema.fields, T.StructField("n", T.LongType())]))
    else:
        counts = src.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    return counts.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], F.col("v").alias(names[0]), F.col("n").alias(names[1]))


def combine(*tables: DataFrame, names: tuple[str, str] = NAMES) -> DataFrame:
    """The frequency table of all rows behind the given tables."""
    value, n = names
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*[c for c in out.columns if c != n]).agg(F.sum(n).alias(n))


def percentiles(freq: DataFrame, permille: Sequence[int], names: tuple[str, str] = NAMES, levels: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Nearest-rank percentiles of a frequency table: columns ``groups``, ``permille``, then ``names``.

    The p-permille value is the smallest value whose running count reaches ``ceil(p * n / 1000)``
    (at least 1). The last column is the count of the group. Groups without counts give no row. A group
    and value may have several rows.

    ``levels`` are sets of group columns (all of them, unless told otherwise); each gives its own rows,
    with NULL in the columns that it leaves out. One sorted table serves all levels: it is in the order
    of the columns that they share and the value, and the counts of what a level leaves out (the days
    of a period, say) add up in the running sums.
    """
    value, n = names
    groups = [c for c in freq.columns if c not in names]
    keys = {g: f"g{i}" for i, g in enumerate(groups)}
    levels = [groups] if levels is None else levels
    shared = [keys[g] for g in groups if all(g in level for level in levels)]
    src = freq.select(*[F.col(f"`{g}`").alias(k) for g, k in keys.items()], F.col(f"`{value}`").alias("value"), F.col(f"`{n}`").alias("n")).where("n > 0")
    # kept once: bounds of a range partitioning come from a sample, and all readers must see the same
    spark = freq.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.spark_partition_id()
    ranged = src.repartitionByRange(parts, *shared, "value").withColumn("part", part)
    table = kept_in_buckets(ranged.withColumn("place", F.get(F.lit(bucket_keys(spark, parts)), part)), parts, "place", ("place", *shared, "value"))
    out = None
    for level in levels:
        hits = _level(table, [keys[g] for g in groups if g in level], permille)
        columns = [(F.col(k) if g in level else F.lit(None).cast(freq.schema[g].dataType)).alias(g) for g, k in keys.items()]
        rows = hits.select(*columns, F.col("p").alias("permille"), F.col("value").alias(value), F.col("total").alias(n))
        out = rows if out is None else out.unionByName(rows)
    return out


def _level(table: DataFrame, keys: list[str], permille: Sequence[int]) -> DataFrame:
    """Percentiles by ``keys`` of the sorted table: keys, p, value, total."""
    sums = table.groupBy("place", *keys).agg(F.sum("n").alias("m"), F.first("part").alias("part"))
    by_group = Window.partitionBy(*keys)
    offsets = kept(sums.select(
        "place", *keys,
        (F.sum("m").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m")).alias("before"),
        F.sum("m").over(by_group).alias("total"),
    ))
    named = offsets.toDF("o_place", *[f"o_{k}" for k in keys], "before", "total")
    if named.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    same = F.col("place") == F.col("o_place")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"o_{k}"))
    up = Window.partitionBy("place", *keys).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = table.join(named, same).select(*keys, "value", "n", "total", (F.col("before") + F.sum("n").over(up)).alias("cum"))
    ranks = F.array(*[F.expr(f"struct({int(p)} AS p, greatest(1L, (total * {int(p)} + 999) div 1000) AS r)") for p in permille])
    return full.select(*keys, "value", "total", F.inline(F.filter(ranks, lambda x: (x["r"] <= F.col("cum")) & (x["r"] > F.col("cum") - F.col("n"))))).select(*keys, "p", "value", "total")
