import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.llm import subjects

TOPICS = {
    "law": "court statute plaintiff licence contract damages appeal clause verdict filing".split(),
    "sport": "goal league coach match stadium sprint squad season team referee".split(),
    "verse": "moon river shadow whisper silence burning window stranger honey thunder".split(),
}
PLAIN = "page note list later elsewhere summary entry remark section answer".split()


def passage(rnd, words, verse=False):
    text = " ".join(["the", *rnd.choices(words, k=5), rnd.choice(PLAIN)])
    return text if verse else text.capitalize() + "."


def doc(rnd, plan):
    out = []
    for topic, n in plan:
        verse = topic == "verse"
        out.append(("\n" if verse else " ").join(passage(rnd, TOPICS.get(topic, PLAIN), verse) for _ in range(n)))
    return "\n".join(out)


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(6)
    plans = [[(t, 8)] for t in TOPICS for _ in range(40)] + [[("law", 5), ("sport", 5)] for _ in range(20)] + [[("law", 9), ("sport", 1)] for _ in range(10)] + [[("none", 8)] for _ in range(10)]
    docs, labels, truth = [], [], {}
    for i, plan in enumerate(plans):
        docs.append((i, doc(rnd, plan), "x"))
        total = sum(n for _, n in plan)
        truth[i] = {t for t, n in plan if t in TOPICS and n / total >= 0.25}
        for t in truth[i]:
            labels.append((i, t if rnd.random() > 0.05 else "sport", "a"))
    labels += [(0, None, "b"), (1, "no subject", "b"), (99999, "law", "b")]
    docs += [(5000, None, "x"), (5001, "", "x"), (5002, "?? !!", "x"), (5003, passage(rnd, TOPICS["law"]) * 3000, "x")]
    truth[5003] = {"law"}
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    areas = spark.createDataFrame([(t,) for t in TOPICS], "subject string")
    return d, lab, areas, truth


def test_subjects_of_a_corpus(corpus):
    d, lab, areas, truth = corpus
    rules = subjects.mine(d, lab, areas)
    rows = subjects.shares(d, rules).collect()
    got = {}
    for r in rows:
        assert 0 < r.share <= 1 and 0 <= r.confidence <= 1
        if r.share >= subjects.SHARE:
            got.setdefault(r.doc_id, set()).add(r.subject)
    docs = set(truth)
    right = sum(got.get(i, set()) == truth[i] for i in docs)
    assert right / len(docs) > 0.95
    assert not {5000, 5001, 5002} & set(got)
    assert subjects.shares(d.where("false"), rules).count() == 0


def test_redundant_rules_are_pruned(corpus):
    d, lab, areas, _ = corpus
    rules = subjects.mine(d, lab, areas)
    # single words decide here, so pairs add nothing
    assert len(rules.keys) <= 3 * len(rules.index)
    assert "court" in rules.index and "page" not in rules.index


def test_pairs_count_only_together():
    r = subjects.Rules(["a", "b"], {("x",): {0: 1.0}, ("y", "z"): {1: 3.0}})
    e = r.evidence(subjects.Passages(["x.\ny.\ny z.\nq.\nx y z. z y"]))
    assert e.tolist() == [[1, 0], [0, 0], [0, 3], [0, 0], [1, 3], [0, 3]]


def test_no_labels_give_no_rules(spark, corpus):
    d, lab, areas, _ = corpus
    rules = subjects.mine(d, lab.where("false"), areas)
    assert subjects.shares(d, rules).count() == 0


def test_passages():
    p = subjects.Passages(["First one. Second one! 12\r\nline of four words\nanother line of FIVE words\n\nA last line without stop", None, "", " \n ", "?!", "Añil; añil - 7 x"])
    assert p.words.tolist() == [2, 2, 1, 4, 5, 5, 1, 3] and p.text.tolist() == [0] * 6 + [5] * 2
    assert [subjects.VERSE in x for x in p.lists().to_pylist()] == [False, False, False, True, True, False, False, False]
    assert [sorted(x) for x in p.lists().to_pylist()[-2:]] == [["anil"], ["anil", "x"]] and p.lists().to_pylist()[2] == []


def test_runs_of_short_lines_are_one_passage():
    p = subjects.Passages(["one\n\ntwo\nthree four\nand a longer line here\nfive\nStop.\nsix"])
    assert p.words.tolist() == [4, 5, 1, 1, 1] and p.lists().to_pylist()[0] == ["one", "two", "three", "four"]


def brute_growth(train, least):
    """Every body that ``grow`` describes, by plain recursion over sets."""
    order = {}
    for _, _, x in train:
        for w in set(x):
            order[w] = order.get(w, 0) + 1
    rank = sorted(order, key=lambda w: (order[w], w))

    def counts(body):
        rows = [(d, s) for d, s, x in train if set(body) <= set(x)]
        docs = {s: len({d for d, z in rows if z == s}) for s in "ab"}
        return {s: sum(z == s for _, z in rows) for s in "ab"}, docs

    telling = []
    for w in rank:
        passages, docs = counts([w])
        if max(docs.values()) >= subjects.MIN_DOCS and max(docs.values()) >= subjects.TELLING * sum(docs.values()) and max(passages.values()) >= least:
            telling.append(w)
    found = set()

    def extend(body, at, sure):
        for i in range(at, len(telling)):
            new = [*body, telling[i]]
            passages, docs = counts(new)
            total, more = sum(docs.values()), False
            conf = {s: docs[s] / (total + subjects.UNSEEN_DOCS * len(new)) for s in "ab"}
            for s in "ab":
                if passages[s] >= least and docs[s] >= subjects.MIN_DOCS and (sure is None or conf[s] >= sure[s] + subjects.GAIN):
                    if docs[s] >= subjects.MIN_CONFIDENCE * total:
                        found.add((tuple(new), s, passages[s], docs[s], total))
                    more |= docs[s] / (docs[s] + subjects.UNSEEN_DOCS * (len(new) + 1)) >= conf[s] + subjects.GAIN
            if more:
                extend(new, i + 1, conf)

    extend([], 0, None)
    return found


def hidden_conjunction(rnd, n):
    """Documents of b hold some of five words, documents of a often all of them."""
    out = []
    for i in range(n):
        s = "ab"[i // 3 % 2]
        some = list("klmno") if s == "a" and rnd.random() < 0.7 else rnd.sample("klmno", rnd.randint(2, 4))
        out.append((i // 3, s, some + rnd.sample("pqrst", rnd.randint(0, 3))))
    return out


def test_bodies_are_those_of_plain_recursion(spark):
    from pyspark.ml.fpm import FPGrowth

    for seed, n in ((4, 180), (5, 900)):
        train = hidden_conjunction(random.Random(seed), n)
        df = spark.createDataFrame(train, "d long, s string, items array<string>").repartition(3)
        rows = subjects.grow(df, 9).collect()
        got = {(tuple(r.body), r.s, r.passages, r.docs, r["all"]) for r in rows}
        assert got == brute_growth(train, 9) and len(got) == len(rows) and got
        # supports are those of the library's own unbounded growth
        sets = FPGrowth(itemsCol="items", minSupport=8.5 / n, minConfidence=1.0).fit(spark.createDataFrame([(["=" + s, *x],) for _, s, x in train], "items array<string>")).freqItemsets.collect()
        support = {frozenset(r["items"]): r["freq"] for r in sets}
        assert all(support[frozenset(["=" + s, *body])] == k for body, s, k, _, _ in got)
    assert max(len(body) for body, *_ in got) > 2


def test_rules_of_several_words_match_whole():
    r = subjects.Rules(["a", "b"], {("x", "y", "z"): {0: 2.0}, ("y", "z"): {1: 1.0}, ("z",): {1: 0.5}})
    p = subjects.Passages(["x y.", "z y x.", "y z.", "z.", "x z."])
    want = [[0, 0], [2, 1.5], [0, 1.5], [0, 0.5], [0, 0.5]]
    assert r.evidence(p).tolist() == want
    for at_once in (1, 2):
        subjects.AT_ONCE, old = at_once, subjects.AT_ONCE
        try:
            assert r.evidence(p).tolist() == want
        finally:
            subjects.AT_ONCE = old
    again = subjects.Passages.of_lists(p.text, p.words, p.lists())
    assert r.evidence(again).tolist() == want


def test_redundant_bodies():
    c = {(("x",), "a"): 0.8, (("x", "y"), "a"): 0.82, (("y", "z"), "a"): 0.7, (("x", "y", "z"), "a"): 0.84, (("x", "z"), "b"): 0.71}
    assert set(subjects.irredundant(c)) == {(("x",), "a"), (("y", "z"), "a"), (("x", "z"), "b")}


def test_pairs_beside_many_surer_words_give_rules(spark):
    sure = [f"w{i}" for i in range(10)]
    docs = [(i, " ".join([*sure, "p", "q"] if i % 2 else ["p", "t"] if i % 4 else ["q", "u"]) + ".") for i in range(120)]
    labels = [(i, "ab"[i % 2 == 0]) for i in range(120)]
    areas = spark.createDataFrame([("a",), ("b",)], "subject string")
    rules = subjects.mine(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string"), areas)
    p, q = rules.index.get("p"), rules.index.get("q")
    assert p is not None and q is not None and not rules.weight[[p, q]].any()
    assert min(p, q) * len(rules.index) + max(p, q) in rules.keys


def test_too_many_subjects_are_an_error(spark, corpus):
    d, lab, _, _ = corpus
    many = spark.range(subjects.MAX_SUBJECTS + 1).select(F.col("id").cast("string").alias("subject"))
    with pytest.raises(ValueError, match="subjects"):
        subjects.mine(d, lab, many)
    rules = subjects.mine(d, lab.where("false"), many.where("subject <> '0'"))
    assert len(rules.subjects) == subjects.MAX_SUBJECTS


def test_the_calibrated_chance_decides():
    # "weak" is right in half of the held-out passages
    r = subjects.Rules(["a", "b"], {("weak",): {0: 4.0}, ("sure",): {0: 5.0}})
    p = subjects.Passages(["weak.", "sure.", "other."])
    r.calibrate(np.array([4.0, 5.0]), np.array([40.0, 40.0]), np.array([20.0, 40.0]))
    assert r.assign(p)[0].tolist() == [0, 0, -1]  # too few: leads are taken as log-odds
    r.calibrate(np.array([4.0, 5.0]), np.array([200.0, 200.0]), np.array([100.0, 200.0]))
    subject, chance = r.assign(p)
    assert subject.tolist() == [-1, 0, -1] and chance[0] == pytest.approx(0.5, abs=0.05) and chance[1] == 1
    assert r.assign(p, least=0.4)[0].tolist() == [0, 0, -1]
    low = subjects.Rules(["a", "b"], {("sure",): {0: 1.0}})
    assert low.assign(p)[0].tolist() == [-1, -1, -1]


def test_the_least_chance_is_chosen_on_held_out_documents(spark):
    # passages with "weak" are about nothing: documents with a few of them have no further subject
    weak = [(i, 0, ["b"] if i % 3 else ["a"], 4, ["weak"]) for i in range(150)]
    sure = [(i, 0, ["b"], 6, ["sure"]) for i in range(150) for _ in range(2) if i % 3]
    rules = subjects.Rules(["a", "b"], {("weak",): {0: 3.0}, ("sure",): {1: 4.0}})
    held = spark.createDataFrame(weak + sure, "d long, h long, ss array<string>, words long, items array<string>")
    subjects._tune(rules, held, 3)
    assert rules.curve[1][0] < 0.4 and rules.least >= 0.5
    assert rules.assign(subjects.Passages(["weak.", "sure."]))[0].tolist() == [-1, 1]


def test_the_sample_of_passages_is_bounded(spark, corpus):
    d, lab, areas, truth = corpus
    rules = subjects.mine(d, lab, areas, train_passages=400)
    got = {(r.doc_id, r.subject) for r in subjects.shares(d, rules).where(F.col("share") >= subjects.SHARE).collect()}
    want = {(i, x) for i, xs in truth.items() for x in xs}
    assert len(got & want) / len(want) > 0.9
