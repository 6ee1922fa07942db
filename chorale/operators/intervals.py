"""Union of time intervals per entity through sharded run bitmaps, and the gaps between them.

Time is cut into exact integer units and the units into shards of ``2 ** shard_bits``. Inside a
shard the covered units form a bitmap held as runs: sorted, disjoint ``(start, end)`` pairs of
uint32, the form in which long stretches of set bits cost eight bytes. Bitmaps are united before
the shuffle (all rows of a batch that share entity and shard), shuffled by entity *and* shard, and
united again. Set runs are periods, clear runs between set runs are gaps. Only the first and last
run of each shard go on to a window per entity, which joins periods that touch across shard bounds
and finds the gaps that lie between shards, so even an entity with a third of all rows sends no
more than two rows a shard to one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECES = 1 << 20  # pieces of spans worked on at once


def union_by_key(key: np.ndarray, s: np.ndarray, e: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint maximal runs per key, ordered by key and start. Bounds lie in ``[0, 2**bits]``."""
    if not len(key):
        return key, s, e
    order = np.lexsort((s, key))
    key, s, e = key[order], s[order], e[order]
    base = key.astype(np.int64) << (bits + 1)
    reach = np.maximum.accumulate(base + e)
    first = np.ones(len(key), bool)
    first[1:] = base[1:] + s[1:] > reach[:-1]
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(key)) - 1
    return key[at], s[at], reach[last] - base[at]


def split_by_shard(row: np.ndarray, s: np.ndarray, e: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Spans as pieces (row, shard, start, end inside the shard), some ``PIECES`` at a time."""
    lo, hi = s >> bits, (e - 1) >> bits
    while len(row):
        n = np.minimum(hi - lo + 1, PIECES)
        take = max(1, int(np.searchsorted(np.cumsum(n), PIECES, "right")))
        n, r, a, z = n[:take], row[:take], s[:take], e[:take]
        shard = np.repeat(lo[:take], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        left = shard << bits
        yield np.repeat(r, n), shard, np.maximum(np.repeat(a, n), left) - left, np.minimum(np.repeat(z, n) - left, 1 << bits)
        rest = lo[:take] + n <= hi[:take]  # a span of more than PIECES shards goes on
        row, s, e = np.append(r[rest], row[take:]), np.append(a[rest], s[take:]), np.append(z[rest], e[take:])
        lo, hi = np.append((lo[:take] + n)[rest], lo[take:]), np.append(hi[:take][rest], hi[take:])


def _codes(columns: Sequence[pa.Array]) -> np.ndarray:
    """An integer per row, equal where all columns are equal (NULL equals NULL)."""
    out = None
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        one = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = one if out is None else np.unique(out * (one.max(initial=0) + 1) + one, return_inverse=True)[1]
    return out if out is not None else np.zeros(0, np.int64)


def _runs_column(key: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Per distinct key (in order) one binary of uint32 pairs; also the index of each key's first run."""
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    data = np.stack([s, e], 1).astype("<u4")
    offsets = np.append(at, len(key)).astype(np.int64) * 8
    return at, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def _read_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, start and end of every run of a binary column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view("<u4").reshape(-1, 2)
    return np.repeat(np.arange(len(column)), np.diff(offsets) // 8), data[:, 0].astype(np.int64), data[:, 1].astype(np.int64)


def merge_intervals(df: DataFrame, entity: Sequence[str], spans: Column, shard_bits: int = 22, names: Sequence[str] = ("kind", "start_unit", "end_unit")) -> DataFrame:
    """Continuous periods and the gaps between them, per entity.

    ``spans`` is an ARRAY<STRUCT<s BIGINT, e BIGINT>> of half-open intervals in integer units; a
    table with one interval per row passes ``F.array(F.struct(...))``. The result has the entity
    columns, then ``names``: 'period' or 'gap', first unit, unit after the last. Touching intervals
    join; a gap is never empty.

    Defined cases: NULL arrays, NULL elements, NULL bounds and spans with e <= s are ignored; an
    entity without any sound span gives no row; NULL is an entity of its own; repeats change
    nothing; an empty table gives an empty result; all other columns of ``df`` are ignored, so
    their names can't clash.
    """
    spark_names = [f"e{i}" for i in range(len(entity))]
    keys = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(entity, spark_names)], spans.alias("iv"))
    fields = [T.StructField(n, keys.schema[n].dataType) for n in spark_names]
    mapped = T.StructType([*fields, T.StructField("shard", T.LongType()), T.StructField("runs", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            iv = b.column(len(spark_names))
            counts = np.nan_to_num(pc.list_value_length(iv).to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
            flat = iv.flatten()
            row = np.repeat(np.arange(len(b)), counts)
            ok = pc.fill_null(pc.greater(pc.struct_field(flat, 1), pc.struct_field(flat, 0)), False).to_numpy(zero_copy_only=False)
            flat = flat.filter(pa.array(ok))
            s, e = (pc.struct_field(flat, i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            code = _codes([b.column(i) for i in range(len(spark_names))])
            for r, shard, a, z in split_by_shard(row[ok], s, e, shard_bits):
                pair, back = np.unique(np.stack([code[r], shard], 1), axis=0, return_inverse=True)
                back = back.reshape(-1)
                some_row = np.zeros(len(pair), np.int64)
                some_row[back] = r
                k, a, z = union_by_key(back, a, z, shard_bits)
                at, runs = _runs_column(k, a, z)
                pick = pa.array(some_row[k[at]])
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(pick) for i in range(len(spark_names))], pa.array(pair[k[at], 1]), runs.cast(pa.binary())], names=[*spark_names, "shard", "runs"])

    decoded = T.StructType([*fields, T.StructField("shard", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by entity and shard, so the last key of a batch may go on in the next."""
        held: pa.Table | None = None
        n = len(spark_names) + 1

        def emit(t: pa.Table) -> pa.RecordBatch:
            code = _codes([t.column(i) for i in range(n)])
            change = np.append(True, code[1:] != code[:-1]) if len(code) else np.zeros(0, bool)
            key = np.cumsum(change) - 1
            first_row = np.flatnonzero(change)
            row, s, e = _read_runs(t.column(n).combine_chunks())
            k, s, e = union_by_key(key[row], s, e, shard_bits)
            left = t.column(n - 1).to_numpy()[first_row[k]] << shard_bits
            s, e = s + left, e + left
            head = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
            tail = np.append(head[1:], True) if len(k) else head
            kind = np.where(head | tail, "edge", "period")
            inner = np.flatnonzero(~head)
            k2, s2, e2 = np.append(k, k[inner]), np.append(s, e[inner - 1]), np.append(e, s[inner])
            kind = np.append(kind, np.full(len(inner), "gap"))
            pick = pa.array(first_row[k2])
            cols = [t.column(i).combine_chunks().take(pick) for i in range(n)]
            return pa.RecordBatch.from_arrays([*cols, pa.array(kind.tolist(), pa.string()), pa.array(s2), pa.array(e2)], names=[*spark_names, "shard", "kind", "s", "e"])

        for b in batches:
            t = pa.Table.from_batches([b])
            if not len(t):
                continue
            t = pa.concat_tables([held, t]) if held is not None else t
            code = _codes([t.column(i) for i in range(n)])
            other = np.flatnonzero(code != code[-1])
            done = int(other[-1]) + 1 if len(other) else 0
            if done:
                yield emit(t.slice(0, done))
            held = t.slice(done)
            if len(held) > 64:  # one key over many rows: keep its united bitmap only
                row, s, e = _read_runs(held.column(n).combine_chunks())
                _, s, e = union_by_key(np.zeros(len(row), np.int64), s, e, shard_bits)
                _, runs = _runs_column(np.zeros(len(s), np.int64), s, e)
                held = held.slice(0, 1).set_column(n, "runs", runs.cast(pa.binary()))
        if held is not None:
            yield emit(held)

    shards = keys.mapInArrow(encode, mapped).repartition(*spark_names, "shard").sortWithinPartitions(*spark_names, "shard")
    parts = shards.mapInArrow(decode, decoded)
    inner = parts.where("kind <> 'edge'").select(*spark_names, "kind", "s", "e")
    w = Window.partitionBy(*spark_names).orderBy("s", "e")
    edges = (
        parts.where("kind = 'edge'")
        .withColumn("pe", F.lag("e").over(w))
        .withColumn("ps", F.lag("shard").over(w))
        .withColumn("new", (F.col("pe").isNull() | (F.col("s") > F.col("pe"))).cast("int"))
        .withColumn("island", F.sum("new").over(w))
    )
    joined = edges.groupBy(*spark_names, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by(F.struct("pe", "ps", "shard"), "s").alias("b"))
    between = F.when(F.col("b.ps") != F.col("b.shard"), F.struct(F.lit("gap").alias("kind"), F.col("b.pe").alias("s"), F.col("s").alias("e")))
    stitched = joined.select(*spark_names, F.inline(F.array_compact(F.array(F.struct(F.lit("period").alias("kind"), "s", "e"), between))))
    out = inner.unionByName(stitched)
    return out.select(*[F.col(n).alias(c) for n, c in zip(spark_names, entity)], *[F.col(c).alias(n) for c, n in zip(("kind", "s", "e"), names)])
