import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale import backends
from chorale.operators import experiment, infer, metrics, results, segments
from chorale.schema import RECORD, RESULT
from chorale.sources import audio, host, sinks
from chorale.streaming import ingest


def wav(path, seconds=0.1, rate=8000, channels=2):
    path.parent.mkdir(parents=True, exist_ok=True)
    sinks.write_wav(str(path), np.sin(np.arange(int(seconds * rate) * channels).reshape(-1, channels) / 9).astype(np.float32) / 2, rate)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "corpus"
    for name in ("US1/demucs_ft.wav", "US1/spleeter.wav", "US1/x.y.wav", "US1/.hid.wav", "US1/AUDIO.WAV", "US2/deep/audio.wav", "audio.wav", "a b%ü/audio.wav"):
        wav(root / name)
    (root / "US1/audio.mp3").write_bytes(b"not audio")
    (root / "EMPTY").mkdir()
    return root


def test_scan(spark, tree):
    rows = {(r.isrc, r.path.split("/")[-1]): r.audio_type for r in audio.audio_files(spark, str(tree)).collect()}
    assert rows == {("US1", "demucs_ft.wav"): "demucs_ft", ("US1", "spleeter.wav"): "regular", ("US1", "x.y.wav"): "regular", ("US1", "audio.mp3"): "regular", ("a b%ü", "audio.wav"): "regular"}
    strict = audio.audio_files(spark, str(tree), strict=True).where("audio_type = 'unknown'")
    assert strict.count() == 2
    none = audio.folders_without_audio(audio.folders(spark, str(tree)), audio.audio_files(spark, str(tree)))
    assert {r.isrc for r in none.collect()} == {"EMPTY", "US2"}


def test_scan_of_nothing(spark, tmp_path):
    assert audio.audio_files(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        audio.audio_files(spark, str(tmp_path / "no"))
    assert audio.single_file(spark, str(tmp_path / "no.mp3")).count() == 0


def test_scan_prunes_content(spark, tree):
    plan = audio.audio_files(spark, str(tree))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_decode(tmp_path):
    wav(tmp_path / "a.wav", rate=8000)
    x, rate = audio.decode(str(tmp_path / "a.wav"))
    assert rate == 8000 and x.shape == (800, 2) and abs(x).max() < 0.51
    y, rate = audio.decode((tmp_path / "a.wav").read_bytes(), 4000)
    assert rate == 4000 and y.shape == (400, 2)
    with pytest.raises(ValueError):
        audio.decode(b"ID3 mp3 bytes")


def test_separate_writes_vocals_and_keeps_failures(spark, tree):
    files = audio.audio_files(spark, str(tree)).where("isrc = 'US1' AND path LIKE '%audio.mp3' OR path LIKE '%x.y.wav'")
    rows = {r.path.split("/")[-1]: r for r in infer.separate(files, "stub-separator", "m", "spleeter_11.wav", tasks=2).collect()}
    assert rows["audio.mp3"].error.startswith("ValueError") and rows["audio.mp3"].separation_time is None
    with wave.open(str(tree / "US1/spleeter_11.wav")) as w:
        assert (w.getsampwidth(), w.getnchannels(), w.getframerate()) == (2, 2, 8000)
    assert rows["x.y.wav"].bytes == (tree / "US1/spleeter_11.wav").stat().st_size
    s = metrics.run_summary(spark.createDataFrame([(r.separation_time, r.error, 0) for r in rows.values()], "separation_time double, error string, finished_at int").withColumn("finished_at", F.timestamp_seconds("finished_at"))).first()
    assert (s.processed, s.failed) == (1, 1)


def transcripts(spark, rows):
    return infer.transcribe(spark.createDataFrame(rows, "path string, text string"), "stub", "m1", content=F.col("text"))


def test_transcribe_captures_errors_and_rebuilds_text(spark):
    rows = [("/c/A/audio.mp3", "la la\nlo"), ("/c/B/demucs_ft.wav", ""), ("/c/C/audio.wav", None), ("/c/D/audio.wav", "x" * 100_000)]
    out = transcripts(spark, rows)
    assert out.schema == RESULT
    by = {r.isrc: r for r in out.collect()}
    assert by["A"].full_text == "la la lo" and [s.end for s in by["A"].segments] == [5 / 15, 7 / 15] and by["A"].error is None
    assert by["B"].audio_type == "demucs_ft" and by["B"].segments is None and by["B"].error == by["C"].error == "ValueError: no content"
    assert len(by["D"].full_text) == 100_000
    assert infer.successes(out).count() + infer.failures(out).count() == len(rows)
    joined = out.select("isrc", segments.joined_text(F.col("segments")).alias("j"), "full_text").where("full_text IS NOT NULL").collect()
    assert all(r.j == r.full_text for r in joined)


def test_backend_contract(spark):
    assert set(backends.known()) >= {"openai", "hf-sequential", "hf-chunked", "faster-whisper-sequential", "faster-whisper-chunked", "whisperx", "stub", "spleeter", "demucs"}
    with pytest.raises(ValueError, match="unknown backend"):
        backends.create("nothing")
    with pytest.warns(UserWarning, match="without effect"):
        backends.Options(extra={"depth": 3}).chosen(("beam_size",), {"depth"})
    with pytest.raises(ImportError):
        backends.create("openai").load("large-v3")


def test_open_end_is_an_error(spark, monkeypatch):
    pairs = spark.createDataFrame([([("a", [0.0, 1.0]), ("b", [1.0, None])],)], "c array<struct<text:string,timestamp:array<double>>>")
    s = pairs.select(segments.from_pairs(F.col("c")).alias("segments"))
    assert s.select(segments.has_open_segment(F.col("segments"))).first()[0] is True
    assert [tuple(x) for x in s.first()[0]] == [("a", 0.0, 1.0), ("b", 1.0, None)]


def test_segments_flatten_and_rebuild(spark):
    out = transcripts(spark, [("/c/A/audio.mp3", "one\ntwo\nthree")])
    flat = segments.flattened(out, "isrc")
    assert [r.text for r in flat.orderBy("seg_no").collect()] == ["one", "two", "three"]
    assert segments.rebuilt(flat, "isrc").first().segments == out.first().segments
    assert segments.report_lines(out, "isrc").orderBy("seg_no").first().line == "[0:00:00 -> 0:00:00] one"


def test_append_once_and_export(spark, tmp_path):
    out = transcripts(spark, [("/c/A/audio.mp3", "é la"), ("/c/A/audio.mp3", "é la"), ("/c/B/audio.mp3", "")]).withColumn("run_id", F.lit("r"))
    at = str(tmp_path / "table")
    for _ in range(3):
        sinks.append_once(out, at)
    assert spark.read.parquet(at).count() == 2
    sinks.export_jsonl(spark.read.parquet(at).select(*RESULT.names), str(tmp_path / "json"))
    lines = [json.loads(x) for f in (tmp_path / "json").glob("part-*") for x in f.read_text().splitlines()]
    assert len(lines) == 1 and list(lines[0]) == RECORD.names and lines[0]["alignment_model_load_time"] is None and lines[0]["full_text"] == "é la"


def test_latest_and_unfinished(spark):
    df = spark.createDataFrame([(1, 5, "old"), (1, 9, "new"), (2, 1, "only"), (None, 1, "x")], "id int, t int, v string")
    assert {(r.id, r.v) for r in results.latest(df, "id", "t").collect()} == {(1, "new"), (2, "only"), (None, "x")}
    work = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r.path for r in results.unfinished(work, work.where("path = 'a'"), ["path"]).collect()] == ["b"]


def test_once_keeps_the_first_row_of_a_key(spark, monkeypatch):
    rows = [(1, 5, "f", 0, "late"), (1, 3, "f", 1, "first"), (1, 3, "g", 0, "copy"), (2, 9, "f", 2, "only"), (None, 1, "f", 3, "x"), (None, 2, "f", 4, "y")]
    df = spark.createDataFrame(rows, "id int, at_time int, at_file string, at_row int, v string")
    for bound in (results.BROADCAST_ROWS, 0):
        monkeypatch.setattr(results, "BROADCAST_ROWS", bound)
        got = results.once(df, "id", ("at_time", "at_file", "at_row"))
        assert got.columns == ["id", "v"] and sorted(r.v for r in got.collect()) == ["first", "only", "x", "y"]


def test_an_append_reads_only_the_partitions_it_goes_to(spark, tmp_path):
    at = str(tmp_path / "t")
    old = spark.createDataFrame([(i, f"d{i % 4}") for i in range(40)], "id long, day string")
    sinks.append_once(old, at, ("id",), ("day",), key_decides=True)
    import shutil

    shutil.rmtree(tmp_path / "t" / "day=d3")  # isn't looked at
    new = spark.createDataFrame([(1, "d1"), (41, "d1"), (41, "d1"), (2, "d2"), (50, None), (50, None)], "id long, day string")
    for _ in range(2):
        sinks.append_once(new, at, ("id",), ("day",), key_decides=True)
    assert sorted(r.id for r in spark.read.parquet(at).collect()) == sorted([i for i in range(40) if i % 4 != 3] + [41, 50])
    assert sinks.MAX_TOUCHED >= 4


def test_sweep_removes_what_was_kept(spark):
    from pathlib import Path

    from chorale import session

    df = session.kept(spark.range(3))
    at = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert at.exists() and session.sweep(spark) >= 1 and not at.exists()


def test_host_gpus(tmp_path, spark):
    for i, name in enumerate(("Some GPU 40GB", "Other")):
        (tmp_path / f"0000:0{i}").mkdir()
        (tmp_path / f"0000:0{i}" / "information").write_text(f"Model: \t\t {name}\nIRQ: 1\n")
    assert host.gpu_names(str(tmp_path)) == ["Some GPU 40GB", "Other"]
    assert host.machines(spark).count() == 1


def test_grid(spark):
    m = experiment.matrix(spark)
    assert m.count() == 21 and experiment.versions(m).count() == 105
    lacks = experiment.missing_versions(spark.createDataFrame([("A",)], "isrc string"), spark.createDataFrame([("A", "regular"), ("A", "demucs_ft")], "isrc string, audio_type string"))
    assert {r.audio_type for r in lacks.collect()} == {"demucs_base", "spleeter_11", "spleeter_16"}


def test_shares_and_empty_mean(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string")
    assert {(r.x, r.n, r.percent) for r in metrics.shares(df, F.col("x"), "x").collect()} == {("a", 2, 50.0), ("b", 1, 25.0), (None, 1, 25.0)}
    e = metrics.run_summary(spark.createDataFrame([], "separation_time double, error string, finished_at timestamp")).first()
    assert (e.processed, e.mean_time) == (0, None)


def test_host(tmp_path):
    f = tmp_path / "cpuinfo"
    f.write_text("x : y\nmodel name\t: Some CPU @ 2\nmodel name : other\n")
    assert host.cpu_model(str(f)) == "Some CPU @ 2" and host.cpu_model(str(tmp_path / "no")) == "Unknown" and host.gpu_names() == []


def test_stream_sees_each_file_once(spark, tree, tmp_path):
    def run():
        return ingest.ingest(ingest.new_audio(spark, str(tree)), str(tmp_path / "t"), str(tmp_path / "c"), ("path",), ("audio_type",))

    run()
    n = spark.read.parquet(str(tmp_path / "t")).count()
    run()
    assert spark.read.parquet(str(tmp_path / "t")).count() == n
    wav(tree / "US9/audio.wav")
    run()
    assert spark.read.parquet(str(tmp_path / "t")).count() == n + 1


def test_daily_counts_drop_repeats_and_close_days(spark, tmp_path):
    rows = [(1, "2025-01-01 01:00:00", "a"), (1, "2025-01-01 01:00:00", "a"), (2, "2025-01-01 02:00:00", "a"), (3, "2025-01-02 01:00:00", "b"), (4, "2025-01-09 01:00:00", "a")]
    df = spark.createDataFrame(rows, "id long, t string, g string").withColumn("t", F.to_timestamp("t"))
    df.where("id < 4").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.new_rows(spark, str(tmp_path / "in"), df.schema)
    q = ingest.daily_counts(stream, "id", "t", "2 days", "g").writeStream.format("memory").queryName("daily").outputMode("append").start()
    q.processAllAvailable()
    assert spark.table("daily").count() == 0
    df.where("id = 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert {(str(r.day.start.date()), r.g, r.n) for r in spark.table("daily").collect()} == {("2025-01-01", "a", 2), ("2025-01-02", "b", 1)}
