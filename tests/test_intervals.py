import random

import pytest
from pyspark.sql import functions as F

from chorale.operators.intervals import merge_intervals

SPAN = "array<struct<s:bigint,e:bigint>>"


def brute(rows):
    by = {}
    for k, spans in rows:
        for x in spans or []:
            if x and x[0] is not None and x[1] is not None and x[1] > x[0]:
                by.setdefault(k, []).append(x)
    out = set()
    for k, spans in by.items():
        runs = []
        for s, e in sorted(spans):
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        out |= {(k, "period", s, e) for s, e in runs}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(runs, runs[1:])}
    return out


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, f"k string, iv {SPAN}")
    r = [tuple(x) for x in merge_intervals(df, ["k"], F.col("iv"), **kw).collect()]
    assert len(r) == len(set(r))
    return set(r)


@pytest.mark.parametrize("bits", [3, 6, 22])
def test_random_against_brute_force(spark, bits):
    rnd = random.Random(bits)
    rows = []
    for _ in range(300):
        spans = [(s, s + rnd.choice([0, 1, 2, 7, 30, 400])) for s in (rnd.randint(-50, 2000) for _ in range(rnd.randint(0, 6)))]
        rows.append((rnd.choice(["a", "a", "a", "b", "c", None]), spans))
    assert got(spark, rows, shard_bits=bits) == brute(rows)


def test_nulls_reversed_touching_nested_and_repeats(spark):
    rows = [("a", None), ("a", []), ("a", [None, (None, 3), (5, None), (9, 4), (7, 7)]), ("b", [(0, 10), (2, 3), (10, 12), (0, 10)]), (None, [(1, 2), (4, 5)])]
    assert got(spark, rows) == {("b", "period", 0, 12), (None, "period", 1, 2), (None, "period", 4, 5), (None, "gap", 2, 4)}


def test_empty_table(spark):
    assert got(spark, []) == set()


def test_long_spans_over_many_shards_and_one_row_per_interval(spark):
    df = spark.createDataFrame([("a", 0, 5000), ("a", 6000, 6001), ("a", 4999, 5500)], "kind string, s long, e long")
    out = merge_intervals(df, ["kind"], F.array(F.struct("s", "e")), shard_bits=2, names=("what", "from", "to"))
    assert out.columns == ["kind", "what", "from", "to"]
    assert {tuple(r) for r in out.collect()} == {("a", "period", 0, 5500), ("a", "gap", 5500, 6000), ("a", "period", 6000, 6001)}


def test_one_hot_entity(spark):
    df = spark.range(20000).select(F.lit("x").alias("k"), F.array(F.struct((F.col("id") * 3).alias("s"), (F.col("id") * 3 + 2).alias("e"))).alias("iv"))
    out = merge_intervals(df, ["k"], F.col("iv"), shard_bits=8)
    assert {r.kind: r["count"] for r in out.groupBy("kind").count().collect()} == {"period": 20000, "gap": 19999}


def test_clashing_column_names_and_two_keys(spark):
    df = spark.createDataFrame([(1, "x", 5, [(0, 1), (2, 3)])], f"shard long, runs string, island long, iv {SPAN}")
    out = merge_intervals(df, ["shard", "runs"], F.col("iv")).collect()
    assert {tuple(r) for r in out} == {(1, "x", "period", 0, 1), (1, "x", "gap", 1, 2), (1, "x", "period", 2, 3)}
