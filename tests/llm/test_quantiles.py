import math
import random

import pytest
from pyspark.sql import functions as F

from chorale.llm import quantiles

PS = [1, 10, 250, 500, 900, 999, 1000]


def brute(rows, ps=PS):
    by = {}
    for *g, v in rows:
        if v is not None and 0 < v < math.inf:
            by.setdefault(tuple(g), []).append(v)
    return {(*g, p, sorted(v)[max(1, -(-p * len(v) // 1000)) - 1], len(v)) for g, v in by.items() for p in ps}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    out = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice([1, 2]), rnd.choice([None, float("nan"), math.inf, -1.0, 0.0, rnd.lognormvariate(1, 2), round(rnd.random(), 1), 7.0])) for _ in range(4000)]
    return out + [("one", 1, 3.5), ("none", 1, None)]


def test_exact_percentiles(spark, rows):
    df = spark.createDataFrame(rows, "v string, value int, n double").withColumn("part", F.lit("x")).repartition(5)
    names = ("x", "count")
    f = quantiles.frequencies(df, ["v", "value"], F.col("n"), names=names)  # names that the operator uses inside
    assert {tuple(r) for r in quantiles.percentiles(f, PS, names).collect()} == brute(rows)


def test_daily_tables_combine(spark, rows):
    df = spark.createDataFrame([(g, v) for g, _, v in rows], "g string, v double")
    half = df.withColumn("day", F.monotonically_increasing_id() % 3)
    tables = [quantiles.frequencies(half.where(f"day = {d}"), ["g"], F.col("v")) for d in range(3)]
    assert {tuple(r) for r in quantiles.percentiles(quantiles.combine(*tables), PS).collect()} == brute([(g, v) for g, _, v in rows])


def test_rounded_values_keep_the_error_bound(spark, rows):
    df = spark.createDataFrame([(g, v) for g, _, v in rows], "g string, v double")
    exact = {r[:2]: r[2] for r in brute([(g, v) for g, _, v in rows])}
    for digits in (2, 3):
        for g, p, v, _ in quantiles.percentiles(quantiles.frequencies(df, ["g"], F.col("v"), digits), PS).collect():
            assert abs(v - exact[g, p]) <= 0.5 * 10 ** (1 - digits) * exact[g, p] * (1 + 1e-9)


def test_no_groups_and_empty(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    assert {(r.permille, r.value) for r in quantiles.percentiles(quantiles.frequencies(df, [], F.col("v")), [500, 990]).collect()} == {(500, 50.0), (990, 99.0)}
    assert quantiles.percentiles(quantiles.frequencies(df.where("v < 0"), [], F.col("v")), [500]).collect() == []


def test_levels_share_one_table(spark, rows):
    df = spark.createDataFrame(rows, "g string, day int, v double").repartition(5)
    f = quantiles.frequencies(df, ["day", "g"], F.col("v"))
    got = {tuple(r) for r in quantiles.percentiles(f, PS, levels=[["g", "day"], ["g"], []]).collect()}
    want = {(d, g, *x) for g, d, *x in brute(rows)} | {(None, g, *x) for g, *x in brute([(g, v) for g, _, v in rows])} | {(None, None, *x) for x in brute([(v,) for _, _, v in rows])}
    assert got == want
