import random
import unicodedata

import numpy as np

from chorale.llm import leaks
from chorale.llm.words import folded, letter_words


def distance(p, t):
    """Least edit distance of p to any substring of t."""
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        old, row = row, [i]
        for j, y in enumerate(t, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return min(row)


def test_myers_against_dynamic_programme():
    rnd = np.random.default_rng(1)
    for m, n in ((1, 3), (5, 9), (12, 14), (40, 60)):
        p, t = rnd.integers(0, 4, (60, m)), rnd.integers(0, 4, (60, n))
        want = [distance(a.tolist(), b.tolist()) for a, b in zip(p, t)]
        assert leaks.myers(p, t).tolist() == want


def make(seed, budget):
    rnd = random.Random(seed)
    vocabulary = [chr(97 + i) + chr(97 + j) for i in range(12) for j in range(8)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 11, 12, 13, 40])))) for i in range(25)]
    docs = []
    for d in range(120):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            w = rnd.choice(items)[1].split()
            a = rnd.randint(0, max(0, len(w) - 9))
            part = w[a : a + rnd.randint(8, 20)]
            for _ in range(rnd.choice([0, 0, 1, 2])):
                i = rnd.randrange(len(part))
                part[i : i + rnd.choice([0, 1])] = rnd.choice([[], ["zz"]])
            at = rnd.randint(0, len(words))
            words[at:at] = part
        docs.append((d, "\n".join(words).upper() if d % 3 else ", ".join(words)))
    return items, docs


def test_windows_within_the_budget_against_brute_force(spark):
    for budget in (0, 1, 2):
        items, docs = make(budget, budget)
        df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        got = {(r.doc_id, r.item_id): (r.edits, r.run) for r in leaks.find_leaks(df, it, budget=budget, block_chars=600).collect()}
        want = {}
        for d, t in docs:
            w = letter_words(t)
            for i, x in items:
                p = letter_words(x)
                edits = min((distance(p[a : a + 12], w) for a in range(len(p) - 11)), default=99)
                if edits <= budget:
                    run = max((n for a in range(len(p)) for n in range(len(p) - a, 0, -1) if any(w[k : k + n] == p[a : a + n] for k in range(len(w)))), default=0)
                    want[d, i] = edits, run
        assert {k: e for k, (e, _) in got.items()} == {k: e for k, (e, _) in want.items()}
        exact = {k for k, (_, r) in want.items() if r >= 12}
        assert {k for k, (_, r) in got.items() if r >= 12} == exact and exact


def test_dress_of_words():
    plain = "canción perdida łódź straße"
    want = ["cancion", "perdida", "lodz", "strasse"]
    for text in (plain, plain.upper(), unicodedata.normalize("NFD", plain), "[00:12.3] canci&oacute;n\r\n12 perdida * łódź_STRASSE", plain.encode().decode("latin-1"), "﻿canción 1 perdida — łódź (straße)"):
        assert letter_words(text) == want, text
    assert folded("") == "" and letter_words("12 _ &amp; 3") == []


def test_nulls_empty_tables_and_long_texts(spark):
    passage = " ".join(f"{a}{b}" for a in "abcd" for b in "wxyz")
    items = spark.createDataFrame([(1, passage), (2, None), (3, ""), (None, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "noise " * 50_000 + passage, 3), (3, passage, 4)], "doc_id long, text string, edits int")
    assert [(r.doc_id, r.item_id, r.edits, r.run) for r in leaks.find_leaks(docs, items).collect()] == [(3, 1, 0, 16)]
    assert leaks.find_leaks(docs.where("false"), items).count() == 0 and leaks.find_leaks(docs, items.where("false")).count() == 0


def test_masks_are_made_once_a_pattern():
    rnd = np.random.default_rng(3)
    p, t, which = rnd.integers(0, 5, (4, 12)), rnd.integers(-1, 6, (50, 16)), rnd.integers(0, 4, 50)
    keys, masks, base = leaks.match_masks(p)
    assert len(keys) == sum(len(set(x)) for x in p.tolist()) and base > p.max()
    assert all(bin(int(m)).count("1") == p[k // base].tolist().count(k % base - 1) for k, m in zip(keys.tolist(), masks))
    assert leaks.myers(p, t, which).tolist() == [distance(p[w].tolist(), x) for w, x in zip(which, t.tolist())]
