import random
from datetime import timedelta
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from chorale.functions import labels, paths, timing, wer

PATHS = ["/c/US1/audio.mp3", "/c/US1/Demucs_FT.wav", "/c/US1/x.y.wav", "/c/US1/.wav", "/c/US1/audio.", "/c/US1/noext", "/c/US1/spleeter.wav"]


def test_path_expressions(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    p = F.col("path")
    rows = df.select("path", paths.isrc_of(p), paths.stem_of(p), paths.audio_type_of(p), paths.audio_type_of(p, strict=True)).collect()
    for path, isrc, stem, kind, strict in rows:
        assert isrc == "US1"
        assert stem == PurePosixPath(path).stem.lower()
        want = {"audio": "regular", "demucs_ft": "demucs_ft"}.get(stem)
        assert kind == (want or "regular") and strict == (want or "unknown")


def test_clock(spark):
    values = [0.0, 0.99, 59.9, 61.0, 3599.999, 3600.0, 86399.9, 86400.0, 90061.5, 200000.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for x, text in df.select("x", timing.clock(F.col("x"))).collect():
        assert text == str(timedelta(seconds=int(x)))


def test_timing_measures(spark):
    df = spark.createDataFrame([(1.0, 4.0), (1.0, 0.0), (None, 3.0), (0.0, 3.0)], "a double, t double")
    rows = df.select(timing.alignment_share(F.col("a"), F.col("t")), timing.without_alignment(F.col("a"), F.col("t")), timing.two_decimals(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(25.0, 3.0, "4.00"), (None, -1.0, "0.00"), (None, None, "3.00"), (0.0, 3.0, "3.00")]


def test_labels(spark):
    want = {"en": "en", " EN ": "en", "en_GB": "en", "eng": "en", "English": "en", "es_419": "es", "português": "pt", "unknown": None, "": None, None: None, "??": None, "cy": "other:cy", "zh-Hant": "other:zh-hant"}
    df = spark.createDataFrame([(k,) for k in want], "l string")
    assert {r[0]: r[1] for r in df.select("l", labels.canonical_language(F.col("l"))).collect()} == want


def textbook(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_word_edits_against_dynamic_programme(spark):
    rnd = random.Random(3)
    for _ in range(400):
        a, b = ([rnd.choice("abcdef") for _ in range(rnd.randint(0, 90))] for _ in range(2))
        assert wer.word_edits(a, b) == textbook(a, b)


def test_word_errors_column(spark):
    df = spark.createDataFrame([("a b c", "A c"), ("", "x y"), (None, None), ("a  b", "a b")], "r string, h string")
    e = wer.word_errors(F.col("r"), F.col("h"))
    rows = df.select(e.alias("e")).select("e.edits", "e.reference_words", F.round(wer.error_rate(F.col("e.edits"), F.col("e.reference_words")), 4)).collect()
    assert [tuple(r) for r in rows] == [(1, 3, 0.3333), (2, 0, None), (0, 0, None), (0, 2, 0.0)]


def test_sound_spans(spark):
    from chorale.sources.tables import sound_spans

    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [("a", 0.0, 1.25), ("b", 1.0, 1.0), ("c", 3.0, 2.0), ("d", None, 1.0), ("e", 1.0, None), None]),
        (2, [("a", nan, 1.0), ("b", 0.0, nan), ("c", -inf, inf), ("d", 0.0, 1e300), ("e", -0.125, 0.125), ("f", 0.004, 0.005)]),
        (3, []),
        (4, None),
    ]
    df = spark.createDataFrame(rows, "id int, segments array<struct<text:string,start:double,end:double>>")
    got = {r.id: [tuple(x) for x in r.s] for r in df.select("id", sound_spans(F.col("segments")).alias("s")).collect()}
    assert got == {1: [(0, 125)], 2: [(-13, 13), (0, 1)], 3: [], 4: []}
