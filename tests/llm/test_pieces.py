import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chorale.llm.pieces import agglomerate, cut_items

SPAN = "array<struct<s:bigint,e:bigint>>"


def greedy(segs, limit):
    """Left to right: each piece as far as it goes, the next from the last segment if that fits."""
    out, i = [], 0
    while segs:
        j, top = i, segs[i][1]
        while j + 1 < len(segs) and max(top, segs[j + 1][1]) - segs[i][0] <= limit:
            j += 1
            top = max(top, segs[j][1])
        out.append((i, j))
        if j == len(segs) - 1:
            return out
        i = j if j > i and max(segs[j][1], segs[j + 1][1]) - segs[j][0] <= limit else j + 1
    return out


spans = st.lists(st.tuples(st.integers(0, 300), st.integers(1, 80)), max_size=30).map(lambda x: sorted((s, s + n) for s, n in x))


@given(spans, st.integers(5, 120))
@settings(max_examples=400, deadline=None)
def test_order_boundaries_give_the_greedy_pieces(segs, limit):
    assert agglomerate([s for s, _ in segs], [e for _, e in segs], limit) == greedy(segs, limit)


@given(spans, st.integers(5, 120), st.booleans())
@settings(max_examples=300, deadline=None)
def test_gap_boundaries_keep_the_limit_and_cover_everything(segs, limit, overlap):
    got = agglomerate([s for s, _ in segs], [e for _, e in segs], limit, "gap", overlap)
    seen = set()
    for a, z in got:
        seen |= set(range(a, z + 1))
        size = max(e for _, e in segs[a : z + 1]) - segs[a][0]
        assert size <= limit or a == z
    assert seen == set(range(len(segs)))
    for (_, z), (a, _) in zip(got, got[1:]):
        assert a in (z, z + 1)


def test_cuts_fall_into_the_longest_pause():
    s, e = [0, 10, 50, 60], [9, 19, 59, 69]
    assert agglomerate(s, e, 30, "gap", overlap=False) == [(0, 1), (2, 3)]


def test_rows(spark):
    rnd = random.Random(4)
    rows = [("a", None), ("b", []), ("c", [None, (None, 2), (5, 5), (9, 3)]), ("d", [(0, 60), (10, 20)]), (None, [(0, 50), (60, 160), (160, 170), (165, 400)]), ("e", [(0, 10), (0, 10), (95, 105)])]
    rows += [(f"r{i}", [(s, s + rnd.randint(1, 50)) for s in (rnd.randint(0, 900) for _ in range(40))]) for i in range(20)]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], f"k string, iv {SPAN}, n int, s string")
    got = {tuple(r) for r in cut_items(df, "k", F.col("iv"), 100).collect()}
    want = set()
    for k, v in rows:
        segs = sorted(x for x in v or [] if x and None not in x and x[1] > x[0])
        if segs and max(e for _, e in segs) - segs[0][0] > 100:
            want |= {(k, n, segs[a][0], max(e for _, e in segs[a : z + 1])) for n, (a, z) in enumerate(greedy(segs, 100), 1)}
    assert got == want


def test_empty_table(spark):
    assert cut_items(spark.createDataFrame([], f"k string, iv {SPAN}"), "k", F.col("iv"), 5).count() == 0


def test_very_long_item():
    n = 20_000
    got = agglomerate(list(range(0, 10 * n, 10)), list(range(9, 10 * n + 9, 10)), 100)
    assert got == greedy([(i, i + 9) for i in range(0, 10 * n, 10)], 100)


@given(spans, st.integers(5, 120), st.integers(0, 4), st.sampled_from(["order", "gap"]))
@settings(max_examples=300, deadline=None)
def test_more_segments_of_overlap(segs, limit, overlap, boundary):
    got = agglomerate([s for s, _ in segs], [e for _, e in segs], limit, boundary, overlap)
    plain = agglomerate([s for s, _ in segs], [e for _, e in segs], limit, boundary, 0)
    assert [z for _, z in plain] == sorted({z for _, z in plain})
    at = 0
    for a, z in got:
        assert at - overlap <= a <= at <= z
        assert max(e for _, e in segs[a : z + 1]) - segs[a][0] <= limit or a == z
        # no further segment of overlap would have kept the limit beside the cluster's first
        if at - overlap < a and a > 0:
            assert max(e for _, e in segs[a - 1 : at + 1]) - segs[a - 1][0] > limit
        at = z + 1
    assert at == len(segs)


def test_oversized_segments_are_cut_if_they_may_be(spark):
    df = spark.createDataFrame([("a", [(0, 250), (260, 300)]), ("b", [(0, 90)])], f"k string, iv {SPAN}")
    rows = [tuple(r) for r in cut_items(df, "k", F.col("iv"), 100, overlap=0, whole=False).collect()]
    assert rows == [("a", 1, 0, 100), ("a", 2, 100, 200), ("a", 3, 200, 300)]
    assert [tuple(r) for r in cut_items(df, "k", F.col("iv"), 100, overlap=0).collect()] == [("a", 1, 0, 250), ("a", 2, 260, 300)]
