"""Problem 5: cutting oversized items at natural boundaries, by agglomerative merging.

An item is a row with an array of atomic segments (start, end). Every segment begins as a cluster;
the pairs of neighbouring clusters lie in a heap under the strength of the boundary between them;
the weakest boundary is taken first and its clusters merged if the merged size, together with the
overlap it carries from the cluster before, keeps the limit. A refused boundary stays: clusters only
grow, so it could not fit later either.

The overlap of a cluster is a number of segments before it (one, unless told otherwise), as far as they
and the cluster's first together keep the limit. The result is one row per piece. An item's segments sit in its own row, so nothing
is shuffled; the work is linear in segments but for the heap's logarithm.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strength of the boundary after segment i, lower merges first. ``order``: earlier boundaries are
#: weaker, so that pieces fill from the left. ``gap``: the silence between segments, so that cuts fall
#: in long pauses; ties go to the earlier boundary.
BOUNDARIES = ("order", "gap")


def agglomerate(s: Sequence[int], e: Sequence[int], limit: int, boundary: str = "order", overlap: int = 1) -> list[tuple[int, int]]:
    """Clusters as (first, last) segment, the overlap included in ``first``; s, e sorted by start then end.

    ``overlap`` is how many segments a cluster repeats at most from before it.
    """
    n = len(s)
    if not n:
        return []
    carry, reach_of = [0] * n, list(e)  # where a cluster that starts at segment i begins with its overlap, and how far that reaches
    for i in range(1, n):
        carry[i], top = i, e[i]
        for j in range(i - 1, max(-1, i - 1 - overlap), -1):
            top = max(top, e[j])
            if top - s[j] > limit:
                break
            carry[i], reach_of[i] = j, top
    last, first, top = list(range(n)), list(range(n)), list(e)  # by cluster's first, by its last, largest end by first
    strength = list(range(n - 1))
    if boundary == "gap":
        reach, gaps = e[0], []
        for i in range(1, n):
            gaps.append(s[i] - reach)
            reach = max(reach, e[i])
        strength = gaps
    heap = [(strength[i], i) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, i = heapq.heappop(heap)  # the boundary between segments i and i + 1
        a, b = first[i], i + 1
        end = max(top[a], top[b])
        if max(end, reach_of[a]) - s[carry[a]] <= limit:
            top[a], z = end, last[b]
            last[a], first[z] = z, a
    out, a = [], 0
    while a < n:
        out.append((carry[a], last[a]))
        a = last[a] + 1
    return out


def cut_items(df: DataFrame, key: str, spans: Column, limit: int, boundary: str = "order", overlap: int = 1, whole: bool = True, names: Sequence[str] = ("piece_no", "start_unit", "end_unit")) -> DataFrame:
    """Pieces of every item whose spans reach over more than ``limit`` units.

    ``spans`` is ARRAY<STRUCT<s BIGINT, e BIGINT>>, in any order. Result: the key, then ``names``:
    piece number from 1, first start, largest end. A piece repeats up to ``overlap`` segments of what lies
    before it. Segments above the limit are cut into parts of the limit unless they must stay ``whole``.

    Defined cases: NULL arrays, elements and bounds and spans with e <= s are ignored; items without
    sound spans or within the limit give no row; a segment above the limit is a piece alone if segments
    stay whole; equal segments are kept as separate atoms; rows with the same key are cut each
    on their own; a NULL key is kept; an empty table gives an empty result; other columns of ``df``
    are ignored.
    """
    if boundary not in BOUNDARIES:
        raise ValueError(f"boundary must be one of {BOUNDARIES}")
    src = df.select(F.col(f"`{key}`").alias("k"), spans.alias("iv"))
    src = src.where(F.array_max(F.transform("iv", lambda x: x["e"])) - F.array_min(F.transform("iv", lambda x: x["s"])) > limit)
    schema = T.StructType([T.StructField("k", src.schema["k"].dataType), T.StructField("n", T.LongType()), T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            iv = b.column(1)
            counts = pc.fill_null(pc.list_value_length(iv), 0).to_numpy(zero_copy_only=False)
            flat = iv.flatten()
            s, e = (pc.fill_null(pc.struct_field(flat, i), 0).to_numpy(zero_copy_only=False) for i in (0, 1))
            row = np.repeat(np.arange(len(b)), counts)
            ok = e > s
            row, s, e = row[ok], s[ok], e[ok]
            if not whole:
                parts = -((s - e) // limit)
                place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                row, first, last = np.repeat(row, parts), np.repeat(s, parts), np.repeat(e, parts)
                s, e = first + place * limit, np.minimum(first + (place + 1) * limit, last)
            order = np.lexsort((e, s, row))
            row, s, e = row[order], s[order], e[order]
            at = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row)) if len(row) else np.zeros(1, np.int64)
            ids, no, lo, hi = [], [], [], []
            for a, z in zip(at[:-1], at[1:]):
                ss, ee = s[a:z].tolist(), e[a:z].tolist()
                if max(ee) - ss[0] <= limit:
                    continue
                for n, (f, t) in enumerate(agglomerate(ss, ee, limit, boundary, overlap), 1):
                    ids.append(row[a])
                    no.append(n)
                    lo.append(ss[f])
                    hi.append(max(ee[f : t + 1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), *[pa.array(x, pa.int64()) for x in (no, lo, hi)]], names=["k", "n", "s", "e"])

    out = src.mapInArrow(run, schema)
    return out.select(F.col("k").alias(key), *[F.col(c).alias(n) for c, n in zip(("n", "s", "e"), names)])
