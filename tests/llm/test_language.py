import random

import pytest
from pyspark.sql import functions as F

from chorale.llm import language

WORDS = {
    "en": "the and of with when house river light morning never under always your hands remember stranger night window".split(),
    "es": "el la de con cuando casa río luz mañana nunca debajo siempre tus manos recuerdan extraño noche ventana".split(),
    "de": "der die und mit wenn haus fluss licht morgen niemals unter immer deine hände erinnern fremder nacht fenster".split(),
    "ru": "дом река свет утро никогда под всегда твои руки помнят ночь окно когда ветер город снова".split(),
}


def sentence(rnd, lang, n=10):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def machine():
    rnd = random.Random(1)
    texts = [(sentence(rnd, c), c) for c in WORDS for _ in range(120)]
    texts += [(sentence(rnd, "en"), "de") for _ in range(20)]  # wrong labels
    return language.fit([t for t, _ in texts], [c for _, c in texts])


def test_held_out_accuracy(machine):
    rnd = random.Random(2)
    cases = [(sentence(rnd, c, rnd.choice([4, 6, 12])), c) for c in WORDS for _ in range(100)]
    p = machine.probabilities([t for t, _ in cases])
    right = sum(machine.codes[k] == c for k, (_, c) in zip(p.argmax(1), cases))
    assert right / len(cases) > 0.97 and abs(p.sum(1) - 1).max() < 1e-4


def test_kernel_is_presence_of_grams():
    row, f = language.grams(["aaaa", "aaaaaaa", "ab"])
    counts = [int((row == i).sum()) for i in range(3)]
    # ' ', a / ' a', aa, 'a ' / ' aa', aaa, 'aa ' / ' aaa', aaaa, 'aaa '
    assert counts[0] == 11 and counts[1] == 11 and counts[2] == 3 + 3 + 2 + 1
    assert set(f[row == 0]) == set(f[row == 1])


def test_sung_syllables():
    for text in ("la la la la", "oh oh oh yeah", "na na hey hey", "doo doo doo doo", "ay ay ay ay", "ラ ラ ラ ラ"):
        assert language.sung(language.words(text)), text
    for text in ("la casa de la luz", "the night never ends", "du hast es ja"):
        assert not language.sung(language.words(text)), text


def test_texts_segments_and_labels(spark, machine):
    rnd = random.Random(3)
    en, es = [sentence(rnd, "en") for _ in range(6)], [sentence(rnd, "es") for _ in range(2)]
    rows = [
        (1, " ".join(en), en),
        (2, " ".join(en + es), [*en[:3], None, es[0], "la la la la la", "casa río", "", *en[3:], es[1]]),
        (3, "too short", ["too short"]),
        (4, None, None),
        (5, "la la la " * 10, ["la la la la"]),
        (6, sentence(rnd, "ru", 3000), []),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k long, t string, s array<string>, lang string")
    got = {(r.k, r.seg_no): (r.lang, r.confidence) for r in language.languages(df, machine, "k", "t", F.col("s")).collect()}
    assert got[1, -1][0] == "en" and got[2, -1][0] == "en" and got[6, -1][0] == "ru"
    assert {k: v[0] for k, v in got.items() if k[1] >= 0} == {(2, 4): "es", (2, 11): "es"}
    assert 3 not in {k for k, _ in got} and 4 not in {k for k, _ in got} and all(0 <= c <= 1.0001 for _, c in got.values())
    assert language.languages(df.where("false"), machine, "k", "t").count() == 0


def test_needs_two_languages():
    with pytest.raises(ValueError):
        language.fit(["a b c"], ["en"])


def test_training_on_the_tables_names_languages(spark):
    from chorale.sources.tables import table

    r = table(spark, "/root/testdata/sf0.01", "transcription_results")
    m = language.train(r)
    items = table(spark, "/root/testdata/sf0.01", "eval_items").where(F.col("lang").isin(*m.codes)).collect()
    p = m.probabilities([" ".join(language.words(x.text)) for x in items])
    right = sum(m.codes[k] == x.lang for k, x in zip(p.argmax(1), items))
    assert right / len(items) > 0.97


def test_a_label_without_a_language_of_its_own_is_none():
    rnd = random.Random(4)
    rows = [(sentence(rnd, c), c, i) for i, c in enumerate(c for c in ("en", "es", "ru") for _ in range(80))]
    rows += [(sentence(rnd, "en"), "cy", 1000 + i) for i in range(20)]
    m = language.fit([t for t, _, _ in rows], [c for _, c, _ in rows], [i for _, _, i in rows])
    assert m.codes == ("en", "es", "ru")
    many = language.fit([t for t, _, _ in rows], [c for _, c, _ in rows], [i for _, _, i in rows], {"en": 5000, "es": 2000, "ru": 80, "cy": 20})
    assert many.codes == ("en", "es", "ru")


def test_a_text_in_no_known_language_has_none(spark, machine):
    rnd = random.Random(5)
    greek = "φως ποτάμι σπίτι χέρια παράθυρο νύχτα πρωί πάντα ποτέ δρόμος".split()
    rows = [(1, " ".join(rnd.choices(greek, k=60))), (2, sentence(rnd, "en", 40)), (3, " ".join(rnd.choices(greek, k=30)) + " " + sentence(rnd, "es", 60))]
    df = spark.createDataFrame(rows, "k long, t string")
    got = {r.k: (r.lang, r.confidence) for r in language.languages(df, machine, "k", "t").collect()}
    assert got[1] == (None, 0.0) and got[2][0] == "en" and got[3][0] == "es"


def test_a_machine_is_kept_in_a_file(machine, tmp_path):
    machine.save(str(tmp_path / "m.npz"))
    again = language.Machine.load(str(tmp_path / "m.npz"))
    texts = ["la casa de la luz", "the night never ends"]
    assert again.codes == machine.codes and again.gap == machine.gap and again.floor == machine.floor
    assert (again.probabilities(texts) == machine.probabilities(texts)).all()


def test_the_sample_is_bounded_and_takes_whole_texts(spark):
    rnd = random.Random(6)
    rows = [(i, sentence(rnd, "en", 400), "English") for i in range(30)] + [(100 + i, sentence(rnd, "es", 400), "es") for i in range(5)] + [(200, "short", "de"), (201, None, "es"), (202, "x " * 30, None)]
    df = spark.createDataFrame(rows + rows[:3], "result_id long, full_text string, detected_language string")
    parts, count = language.sample(df, "result_id", "full_text", "detected_language", texts=10, snippets=70)
    got = parts.collect()
    assert count == {"en": 30, "es": 6} and sum(r.l == "en" for r in got) == 70 and len({r.h for r in got if r.l == "en"}) <= 10
    whole, _ = language.sample(df, "result_id", "full_text", "detected_language", texts=10, snippets=10_000)
    assert sorted(r.s for r in whole.where("l = 'es'").collect()) == sorted(" ".join(c) for _, t, x in rows if x == "es" and t for c in language.chunks(language.words(t)))
    with pytest.raises(ValueError, match="two languages"):
        language.train(df.where("result_id < 100"))


def test_sung_syllables_need_no_list():
    assert language.sung(["lalala", "laaa", "laaa", "lalala"])
    assert not language.sung("over the wires my mother folded over the wires my mother folded".split())
