"""Problem 7: filling containers of fixed capacity with whole items, by vector best fit.

A bin has three capacities: tokens, documents and attention cost (the sum of squared lengths, what
attention restricted to each document costs). Items are taken from the longest on; of the open bins
in which an item keeps every capacity, the one with the best score is chosen: the smallest weighted
norm of the residual it leaves (``norm``), or the largest weighted dot product of item and residual
(``dot``). Only items above the token capacity are cut, into full parts and a rest.

Items are spread by a hash over shards of about ``SHARD`` items, each packed in one task with only
(id, size, count) rows shuffled. Equal items (a third of all rows may share an id, or have none) are
counted before the shuffle and dealt out in lots of at most a shard. A shard wastes at most about one
bin, so the loss from sharding is below one part in several hundred and doesn't grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
MAX_ITEMS = 64
#: Attention cost that a bin may have: three quarters of that of one text as long as the bin.
COST = CAPACITY * CAPACITY * 3 // 4
SHARD = 8192
WEIGHTS = (1.0, 0.02, 0.02)


def best_fit(size: np.ndarray, capacity: int = CAPACITY, max_items: int = MAX_ITEMS, max_cost: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Bin number of each item; ``size`` is descending, each at most ``capacity``.

    An item that breaks a capacity all by itself (its squared size above ``max_cost``) gets a bin alone.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule must be norm or dot")
    cost = float(max_cost or capacity * capacity)
    bins = np.empty(len(size), np.int64)
    left = np.empty((3, max(len(size), 1)))  # residual share of tokens, items, cost of the open bins
    number = np.empty(max(len(size), 1), np.int64)
    opened = n = 0
    least = size[-1] / capacity if len(size) else 0
    w = np.array(weights)[:, None]
    eps = 1e-9
    for i, x in enumerate(size.tolist()):
        v = np.array([x / capacity, 1 / max_items, x * x / cost])[:, None]
        rest = left[:, :n] - v
        fits = (rest > -eps).all(0)
        if fits.any():
            score = -(w * rest * rest).sum(0) if rule == "norm" else (w * v * left[:, :n]).sum(0)
            score[~fits] = -np.inf
            k = int(score.argmax())
            left[:, k] = rest[:, k]
        else:
            k, n = n, n + 1
            left[:, k], number[k] = 1 - v[:, 0], opened
            opened += 1
        bins[i] = number[k]
        if left[0, k] < least - eps or left[1, k] < 1 / max_items - eps or left[2, k] < -eps:  # nothing fits any more
            n -= 1
            left[:, k], number[k] = left[:, n], number[n]
    return bins


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, max_items: int = MAX_ITEMS, max_cost: int | None = None, rule: str = "norm", shard_items: int = SHARD, expected_rows: int | None = None) -> DataFrame:
    """Places of all items: key, part_no (from 0), n_tokens, bin_id, start (offset in the bin).

    Defined cases: items of size NULL or 0 have one row with bin_id and start NULL, as they fill
    nothing; equal sizes go by key; rows with equal keys are items of their own; an empty table gives
    an empty result; other columns of ``items`` are ignored. ``expected_rows`` (a count of the rows)
    saves counting them.
    """
    src = items.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)).alias("n"))
    rows = expected_rows if expected_rows is not None else src.count()
    shards = max(1, -(-rows // shard_items))
    kind = src.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("n", "descending"), ("k", "ascending")])
        t = t.take(pa.array(np.repeat(np.arange(len(t)), t.column("c").to_numpy())))
        n = t.column("n").to_numpy()
        full = np.maximum(n, 0) // capacity
        rest = np.maximum(n, 0) - full * capacity
        parts = full + (rest > 0) + (n <= 0)
        row = np.repeat(np.arange(len(n)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        length = np.where(part < full[row], capacity, rest[row])
        order = np.lexsort((part, row, -length))
        row, part, length = row[order], part[order], length[order]
        some = length > 0
        bins = best_fit(length[some], capacity, max_items, max_cost, rule)
        place = np.zeros(len(bins), np.int64)
        by_bin = np.argsort(bins, kind="stable")
        run_len = np.cumsum(length[some][by_bin]) - length[some][by_bin]
        head = np.append(True, np.diff(bins[by_bin]) != 0) if len(bins) else np.zeros(0, bool)
        place[by_bin] = run_len - np.repeat(run_len[head], np.diff(np.append(np.flatnonzero(head), len(bins)))) if len(bins) else run_len
        shard = TaskContext.get().partitionId()
        at = np.flatnonzero(some)
        bin_id, start = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        bin_id[at], start[at] = (np.int64(shard) << 32) + bins, place
        yield pa.RecordBatch.from_arrays([t.column("k").combine_chunks().take(pa.array(row)), pa.array(part, pa.int64()), pa.array(length, pa.int64()), pa.array(bin_id, mask=~some), pa.array(start, mask=~some)], names=["k", "part_no", "n_tokens", "bin_id", "start"])

    lots = src.groupBy("k", "n").agg(F.count("*").alias("c"))
    lots = lots.select("k", "n", "c", F.explode(F.sequence(F.lit(0), F.expr(f"(c - 1) div {shard_items}").cast("int"))).alias("lot"))
    spread = lots.select("k", "n", F.least(F.col("c") - F.col("lot") * shard_items, F.lit(shard_items)).cast("bigint").alias("c"), "lot").repartition(shards, F.xxhash64("k", "n", "lot")).drop("lot")
    out = spread.mapInArrow(run, f"k {kind}, part_no bigint, n_tokens bigint, bin_id bigint, start bigint")
    return out.withColumnRenamed("k", key)


def fill_report(packed: DataFrame, capacity: int = CAPACITY, max_cost: int = COST) -> DataFrame:
    """Over all bins: how many, tokens in them, share filled, least possible number of bins, and the attention cost.

    ``highest_cost`` is that of the dearest bin of several items; ``lone_items`` are those that break the
    cost by themselves.
    """
    n = F.col("n_tokens")
    bins = packed.where("bin_id IS NOT NULL").groupBy("bin_id").agg(F.sum(n).alias("t"), F.count("*").alias("c"), F.sum(n * n).alias("q"))
    return bins.agg(
        F.max(F.when(F.col("c") > 1, F.col("q"))).alias("highest_cost"), F.count_if((F.col("c") == 1) & (F.col("q") > max_cost)).alias("lone_items"),
        F.count("*").alias("bins"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.max("c").alias("most_items"),
        F.round(F.try_divide(F.sum("t"), F.count("*") * capacity), 6).alias("filled"), F.ceil(F.sum("t") / capacity).alias("bins_at_least"),
    )
