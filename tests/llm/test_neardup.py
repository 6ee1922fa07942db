import random
import re

import pytest

from chorale.llm import neardup


def brute(rows, k=3, num=3, den=5, least=20):
    word = re.compile(r"[^\W_]+")
    sets = {}
    for i, t in rows:
        w = word.findall((t or "").casefold())
        if i is not None and len(w) >= max(least, k):
            sets.setdefault(i, []).append(frozenset(zip(*(w[j:] for j in range(k)))))
    ids = sorted(sets)
    return {(a, b) for a in ids for b in ids if a < b and any(len(x & y) * den >= num * len(x | y) for x in sets[a] for y in sets[b])}


def edited(rnd, words, n):
    w = list(words)
    for _ in range(n):
        i = rnd.randrange(len(w))
        w[i : i + rnd.choice([0, 1, 1])] = [f"x{rnd.randrange(50)}"]
    return w


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out, i = [], 0
    for _ in range(40):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([20, 25, 60, 200]))]
        for _ in range(rnd.randint(1, 6)):
            i += 1
            out.append((i, " ".join(edited(rnd, base, rnd.choice([0, 0, 1, 2, 4, 8]))).replace("w1", "W1")))
    hot = [f"h{j}" for j in range(50)]
    out += [(1000 + j, " ".join(edited(rnd, hot, j % 7))) for j in range(60)]
    out += [(2000, None), (2001, ""), (2002, "too short"), (None, out[0][1]), (2003, "la " * 30), (2004, "La, la! " * 12), (2005, "é? ! " * 40)]
    return out + out[:10]


@pytest.mark.parametrize("hot,range_bits,bucket", [(neardup.HOT, neardup.RANGE_BITS, neardup.BUCKET), (10, 12, 500), (3, 8, 100)])
def test_pairs_equal_brute_force(spark, rows, hot, range_bits, bucket, monkeypatch):
    if bucket < neardup.BUCKET:
        monkeypatch.setattr(neardup, "PACK_SETS", bucket // 20)
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    s = neardup.Similar(df, "id", "text", hot=hot, range_bits=range_bits, bucket=bucket)
    got = [tuple(r) for r in s.all_pairs(("a", "b")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_other_thresholds(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string")
    s = neardup.Similar(df, "id", "text", k=5, num=4, den=5)
    assert {tuple(r) for r in s.all_pairs().collect()} == brute(rows, 5, 4, 5)


def test_long_lists_are_compared_in_tiles(spark):
    rnd = random.Random(9)
    base = [f"b{j}" for j in range(80)]
    rows = [(i, " ".join(edited(rnd, base[: 40 + i % 40], i % 9))) for i in range(180)]
    s = neardup.Similar(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert {tuple(r) for r in s.all_pairs().collect()} == brute(rows)


def test_classes_and_links(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.result_id: (r.class_id, r.n_links) for r in neardup.Similar(df, "id", "text").classes().collect()}
    pairs = brute(rows)
    parent = {i: i for i in got}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(pairs):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {i: root(i) for i in got} == {i: c for i, (c, _) in got.items()}
    assert {i for i, (_, n) in got.items() if n} == {x for p in pairs for x in p}


def test_frequencies_of_cells(spark):
    from collections import Counter

    import numpy as np

    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcdefghij") for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame([(i % 7, i, t) for i, t in enumerate(texts)], "pack long, id long, text string")
    row, g = neardup.shingles(texts, 3, 20)
    want = Counter(g.tolist())
    mask, low = (1 << 30) - 1, 20
    shared = Counter()
    for x, n in want.items():
        shared[x & mask] += n
    seen = 0
    for r in neardup.frequencies(df, 3, 20, 30, low).collect():
        own = np.unique(np.concatenate([g[row == i] for i in range(r["pack"], 300, 7)]) & np.uint64(mask))
        own = own[own >> np.uint64(low) == r["part"]]
        f = (np.frombuffer(r["totals"], np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32)
        assert len(f) == len(own) and all(0.99 * shared[c] <= x <= shared[c] for c, x in zip(own.tolist(), f.tolist()))
        seen += len(own)
    assert seen == sum(len(set((g[np.isin(row, range(p, 300, 7))] & np.uint64(mask)).tolist())) for p in range(7))


def test_a_hot_class_gives_every_pair_once(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(i, text) for i in range(60)] + [(100, text + " x")], "id long, text string")
    for hot in (1000, 7):
        got = [tuple(r) for r in neardup.Similar(df, "id", "text", hot=hot).all_pairs().collect()]
        assert len(got) == len(set(got)) == 61 * 60 // 2


def test_folded_difference_never_exceeds_the_true_one():
    import numpy as np

    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("abcdefgh") + str(rnd.randrange(9)) for _ in range(rnd.randint(20, 900))) for _ in range(30)]
    row, g = neardup.shingles(texts, 3, 20)
    v = neardup.fold(row, g, len(texts))
    sets = [set(g[row == i].tolist()) for i in range(len(texts))]
    for i in range(30):
        for j in range(30):
            assert int(np.bitwise_count(v[i] ^ v[j]).sum()) <= len(sets[i] ^ sets[j])


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "id long, text string, sig string, rep int")
    s = neardup.Similar(df, "id", "text")
    assert s.all_pairs().count() == 0 and s.classes().count() == 0
    two = spark.createDataFrame([(1, "one two three " * 8, "s", 1), (2, "one two three " * 8, "t", 2)], "id long, text string, sig string, rep int")
    assert [tuple(r) for r in neardup.Similar(two, "id", "text").all_pairs().collect()] == [(1, 2)]


@pytest.mark.parametrize("num,den", [(3, 5), (4, 5), (1, 2), (1, 1)])
def test_similar_sets_reach_each_other_from_their_first_element(num, den):
    rnd = random.Random(7)
    met = 0
    for _ in range(4000):
        base = rnd.sample(range(300), rnd.randint(1, 60))
        a, b = (sorted({x if rnd.random() < 0.85 else rnd.randrange(300) for x in base}) for _ in range(2))
        if len(set(a) & set(b)) * den >= num * len(set(a) | set(b)):
            first = min(set(a) & set(b))
            assert len(b) <= neardup.reach(len(a), a.index(first), num, den) and len(a) <= neardup.reach(len(b), b.index(first), num, den)
            met += 1
    assert met > 50 and neardup.reach(30, 0, num, den) == 30 * den // num


@pytest.mark.parametrize("n", [40, 300])
def test_sets_out_of_reach_are_not_compared(n, monkeypatch):
    import numpy as np

    looked, within = [], neardup._within

    def counted(a, b, num, den):
        looked.append(np.broadcast(a, b).size)
        return within(a, b, num, den)

    monkeypatch.setattr(neardup, "_within", counted)
    vec, size, doc, start = np.full((n, 8), 77, np.uint64), np.full(n, 100), np.arange(n), np.zeros(1, np.int64)
    late = neardup.reach(size, np.full(n, 26), 3, 5)  # what two sets of 100 share from rank 26 on can't be 0.6 of both
    assert len(neardup.compare_lists(doc, late, start, vec, size, 3, 5)) == 0 and sum(looked) == 0
    early = neardup.reach(size, np.where(doc < 5, 25, 26), 3, 5)
    assert len(neardup.compare_lists(doc, early, start, vec, size, 3, 5)) == 5 * 4 // 2 and sum(looked) < 10 * n
