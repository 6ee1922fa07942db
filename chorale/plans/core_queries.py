"""Queries of the core library over the project's tables. ``oracle.py`` has SQL for the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, timing, wer
from ..functions.labels import canonical_language
from ..operators import experiment, infer, metrics, results, segments
from ..operators.intervals import merge_intervals
from ..schema import RECORD
from ..session import folder, kept
from ..sources import audio, sinks
from ..sources.tables import PLACE, placed, sound_spans, table
from ..streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listed file once."""
    t = table(spark, sf_dir, "audio_files")
    return t.groupBy("path").agg(F.max("isrc").alias("isrc"), F.max("audio_type").alias("audio_type"), F.max("length").alias("length"), F.max("duration_s").alias("duration_s"))


def _results(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Chosen columns of each result once; deliveries of a result have the same content."""
    return table(spark, sf_dir, "transcription_results").select("result_id", *cols).dropDuplicates(["result_id"])


def _wide(spark: SparkSession, sf_dir: str, *cols: Column | str) -> DataFrame:
    """As ``_results``, for texts and segments: the first delivery of each result, chosen without shuffling them."""
    t = placed(table(spark, sf_dir, "transcription_results"), "ingested_at", "result_id", *cols)
    return results.once(t, "result_id", PLACE)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of all segments of each result once, read without the texts."""
    pair = F.arrays_zip(F.col("segments.start"), F.col("segments.end"))
    return segments.bounds(_wide(spark, sf_dir, pair.alias("segments")), "result_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "transcription_results")
    return merge_intervals(r, ["result_id"], sound_spans(F.col("segments")), names=("kind", "start_cs", "end_cs"))


def p3_folder_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps over all results of a recording code together, one of which holds a tenth of the rows."""
    r = table(spark, sf_dir, "transcription_results")
    return merge_intervals(r, ["isrc"], sound_spans(F.col("segments")), names=("kind", "start_cs", "end_cs"))


# scans, paths and filters


def isrc_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", paths.isrc_of(F.col("path")).alias("isrc"))


def path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "separation_runs").select("isrc", "output_name").distinct()
    return t.select(paths.joined(F.lit("/corpus"), F.col("isrc"), F.col("output_name")).alias("path"))


def file_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", paths.stem_of(F.col("path")).alias("stem"))


def audio_type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _files(spark, sf_dir).select("path", paths.audio_type_of(p).alias("audio_type"), paths.audio_type_of(p, strict=True).alias("strict_type"))


def audio_extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(F.col("path").rlike(r"\.(wav|mp3)$")).select("path", "length")


def wav_union_mp3(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).select("path")
    return f.where(F.col("path").endswith(".wav")).withColumn("kind", F.lit("wav")).unionByName(f.where(F.col("path").endswith(".mp3")).withColumn("kind", F.lit("mp3")))


def folders_without_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of the split without audio of any length among the outputs of the finetuned separator."""
    full = table(spark, sf_dir, "audio_files").where((F.col("length") > 0) & (paths.audio_type_of(F.col("path")) == "demucs_ft"))
    return audio.folders_without_audio(table(spark, sf_dir, "dataset_split"), full)


def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first file in path order that a separator left under its default name."""
    hit = table(spark, sf_dir, "audio_files").where(paths.audio_type_of(F.col("path"), strict=True) == "unknown")
    return hit.select("path").orderBy("path").limit(1)


def unavailable_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that can't be had from another implementation, as their model isn't available there: which one."""
    r = _results(spark, sf_dir, "model_name", "whisper_implementation").withColumn("own", experiment.family_of())
    others = r.withColumn("family", F.explode(F.array(*[F.lit(f) for f in experiment.FAMILIES]))).where("family <> own")
    return others.join(F.broadcast(experiment.matrix(spark)), ["model_name", "family"], "left_anti").select("result_id", "model_name", "family")


def open_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that break the record's schema: a segment without a bound."""
    r = table(spark, sf_dir, "transcription_results").where(segments.has_open_segment(F.col("segments")))
    return r.select("result_id", F.size("segments").cast("bigint").alias("n")).distinct()


# segments


def segments_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.flattened(_wide(spark, sf_dir, "segments"), "result_id")


def segments_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays taken apart and built again: how many elements, and the last one's text."""
    built = segments.rebuilt(segments.flattened(_wide(spark, sf_dir, "segments"), "result_id"), "result_id")
    return built.select("result_id", F.size("segments").cast("bigint").alias("n"), F.element_at("segments", -1)["text"].alias("last_text"))


def segment_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments through the timestamp-pair form and back."""
    pairs = _wide(spark, sf_dir, "segments").select("result_id", segments.from_pairs(segments.to_pairs(F.col("segments"))).alias("segments"))
    return segments.flattened(pairs, "result_id")


def transcript_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _wide(spark, sf_dir, "segments", "full_text").where("segments IS NOT NULL")
    text = segments.joined_text(segments.from_fields(F.col("segments")))
    return r.select("result_id", text.alias("joined"), F.coalesce(text == F.col("full_text"), F.lit(False)).alias("verbatim"))


def segment_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _spans(spark, sf_dir).where("start >= 0 AND end >= 0")
    return flat.select("result_id", "seg_no", timing.clock(F.col("start")).alias("starts"), timing.clock(F.col("end")).alias("ends"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _wide(spark, sf_dir, "segments").withColumn("segments", F.filter("segments", lambda s: (s["start"] >= 0) & (s["end"] >= 0)))
    return segments.report_lines(r, "result_id")


def chunk_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _spans(spark, sf_dir).where("start >= 0")
    return flat.groupBy("result_id", segments.chunk_no(F.col("start")).alias("chunk")).agg(F.count("*").alias("n"))


def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30-second chunks of each file and the model calls of 16 chunks that they make."""
    f = _files(spark, sf_dir).where("duration_s > 0")
    chunks = F.ceil(F.col("duration_s") / 30).cast("bigint")
    return f.select("path", chunks.alias("chunks"), F.ceil(chunks / 16).cast("bigint").alias("calls"))


# files in a tree


def _written(spark: SparkSession, files: DataFrame, sound: bool) -> str:
    """A corpus in the shared folder with a file for every row (isrc, name, length): a byte, or a short sound as WAV.

    Sample k of both channels is ``(7919 k + length) mod 65536 - 32768``; there are ``100 + length mod 400``.
    """
    root = folder(spark, "corpus")
    plain = root.removeprefix("file:")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for isrc, name, length in f.itertuples(index=False):
                os.makedirs(f"{plain}/{isrc}", exist_ok=True)
                if sound:
                    x = (np.arange(100 + length % 400) * 7919 + length) % 65536 - 32768
                    sinks.write_wav(f"{plain}/{isrc}/{name}", np.repeat(x[:, None] / 32768, 2, 1), 16_000)
                else:
                    with open(f"{plain}/{isrc}/{name}", "wb") as out:
                        out.write(b"-")
            yield pd.DataFrame({"n": [len(f)]})

    files.select("isrc", "name", "length").mapInPandas(write, "n bigint").agg(F.sum("n")).collect()
    return root


def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed files as a tree, scanned as a corpus; each folder's files by audio version."""
    files = _files(spark, sf_dir).select("isrc", paths.file_name(F.col("path")).alias("name"), "length")
    root = _written(spark, files, False)
    return audio.audio_files(spark, root, strict=True).groupBy("isrc", "audio_type").agg(F.count("*").alias("files"), F.min(paths.file_name(F.col("path"))).alias("first_name"))


def tree_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first file of a written tree, taken by itself."""
    files = _files(spark, sf_dir).select("isrc", paths.file_name(F.col("path")).alias("name"), "length")
    root = _written(spark, files, False)
    path = audio.audio_files(spark, root).agg(F.min("path")).first()[0]
    return audio.single_file(spark, path.removeprefix("file:")).select("isrc", paths.file_name(F.col("path")).alias("name"), "audio_type")


def tree_without_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of originals and of what the finetuned separator left; folders without any of the latter."""
    files = _files(spark, sf_dir).select("isrc", paths.file_name(F.col("path")).alias("name"), "length").where("name IN ('audio.mp3', 'demucs_ft.wav')")
    root = _written(spark, files, False)
    return audio.folders_without_audio(audio.folders(spark, root), audio.audio_files(spark, root, ("wav",)))


def tree_separate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short sound for every original, separated by the stub; what the written vocals hold."""
    originals = _files(spark, sf_dir).where(F.col("path").endswith("/audio.mp3")).select("isrc", F.lit("audio.wav").alias("name"), "length")
    root = _written(spark, originals, True)
    runs = infer.separate(audio.audio_files(spark, root), "stub-separator", "stub", "spleeter_16.wav", tasks=spark.sparkContext.defaultParallelism)
    ok = runs.where("error IS NULL").agg(F.count("*")).first()[0]
    vocals = infer.decoded(audio.audio_files(spark, root).where("audio_type = 'spleeter_16'"))
    return vocals.withColumn("separated", F.lit(ok))


# inference contract


def _stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("/corpus/"), F.coalesce("isrc", F.lit("none")), F.lit("/"), F.col("doc_id")).alias("path"), "text")
    return infer.transcribe(docs, "stub", "stub-1", content=F.col("text"), run_id="r0")


def stub_transcribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that the stub backend hears in the documents."""
    ok = infer.successes(_stub(spark, sf_dir)).withColumn("doc_id", paths.file_name(F.col("path")).cast("bigint"))
    return segments.flattened(ok, "doc_id")


def stub_error_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _stub(spark, sf_dir)
    return r.select(paths.file_name(F.col("path")).cast("bigint").alias("doc_id"), F.coalesce("error", F.lit("")).alias("error"))


def transcribe_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stub's records say of themselves."""
    r = _stub(spark, sf_dir)
    return r.select(
        paths.file_name(F.col("path")).cast("bigint").alias("doc_id"), "run_id", "model_name", "whisper_implementation", "audio_type", "detected_language",
        (F.col("transcription_time") >= 0).alias("timed"), F.size("segments").cast("bigint").alias("n"), F.length("full_text").cast("bigint").alias("chars"),
    ).where("timed")


def stored_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and failures written once and kept apart; what each table holds."""
    out = kept(_stub(spark, sf_dir))
    at = folder(spark, "results")
    for _ in range(2):
        sinks.append_once(infer.successes(out), at)
    infer.failures(out).write.mode("append").parquet(f"{at}_errors")
    both = spark.read.parquet(at).select(F.lit("record").alias("kind"), F.lit("").alias("error")).unionByName(spark.read.parquet(f"{at}_errors").select(F.lit("failure").alias("kind"), "error"))
    return both.groupBy("kind", "error").agg(F.count("*").alias("n"))


# metrics


def timing_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of time spent on the alignment model, as it is shown."""
    r = _results(spark, sf_dir, "alignment_model_load_time", "transcription_time").where("alignment_model_load_time IS NOT NULL AND transcription_time <> 0")
    return r.select("result_id", timing.two_decimals(timing.alignment_share(F.col("alignment_model_load_time"), F.col("transcription_time"))).alias("shown"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.run_summary(table(spark, sf_dir, "separation_runs").distinct(), "separator", "output_name")


def run_summary_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of no run at all: no success, no mean."""
    return metrics.run_summary(table(spark, sf_dir, "separation_runs").where("separator = 'none'"))


def realtime_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separation speed against the length of the original file."""
    length = _files(spark, sf_dir).select(F.col("path").alias("p"), "duration_s")
    runs = table(spark, sf_dir, "separation_runs").distinct().where("error IS NULL")
    timed = runs.withColumn("p", F.concat(F.lit("/corpus/"), F.col("isrc"), F.lit("/audio.mp3"))).join(length, "p")
    return metrics.realtime_factor(timed.withColumnRenamed("separation_time", "processing_s"), "separator", "output_name")


def transcription_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcription speed per model and implementation, the alignment model's loading taken off."""
    length = _files(spark, sf_dir).select("path", "duration_s")
    r = _results(spark, sf_dir, "path", "model_name", "whisper_implementation", "transcription_time", "alignment_model_load_time").where("transcription_time > 0 AND transcription_time < double('infinity')")
    took = F.col("transcription_time") - F.coalesce("alignment_model_load_time", F.lit(0.0))
    return metrics.realtime_factor(r.withColumn("processing_s", took).join(length, "path"), "model_name", "whisper_implementation")


def alignment_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _results(spark, sf_dir, "alignment_model_load_time", "transcription_time").where("alignment_model_load_time IS NOT NULL")
    a, t = F.col("alignment_model_load_time"), F.col("transcription_time")
    return r.select("result_id", F.round(timing.alignment_share(a, t), 4).alias("percent"), F.round(timing.without_alignment(a, t), 4).alias("rest_s"))


def language_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _results(spark, sf_dir, "detected_language", "error").where("error IS NULL")
    return metrics.shares(r, F.coalesce(canonical_language(F.col("detected_language")), F.lit("?")), "language")


def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in each part of the split; recordings without an assignment are 'none'."""
    s = table(spark, sf_dir, "dataset_split").groupBy("isrc").agg(F.max("split").alias("split"))
    r = _results(spark, sf_dir, "isrc").groupBy("isrc").agg(F.count("*").alias("k"))  # a hot code is one row before the join
    return r.join(s, "isrc", "left").groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.sum("k").alias("results"), F.count("*").alias("recordings"))


# experiment grid


def model_backend_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.matrix(spark)


def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.versions(experiment.matrix(spark))


def other_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of the models that run under a toolkit of their own."""
    return experiment.versions(experiment.matrix(spark, experiment.OTHERS))


def grid_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in each cell of the grid, empty cells included."""
    r = _results(spark, sf_dir, "model_name", "whisper_implementation", "audio_type", "error").withColumn("family", experiment.family_of())
    done = r.groupBy("model_name", "family", "audio_type").agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    cells = experiment.versions(experiment.matrix(spark))
    return cells.join(done, ["model_name", "family", "audio_type"], "left").na.fill(0, ["ok", "failed"])


def missing_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio versions that recordings of the split lack; default names don't count as a version."""
    f = table(spark, sf_dir, "audio_files").select("isrc", paths.audio_type_of(F.col("path"), strict=True).alias("audio_type"))
    return experiment.missing_versions(table(spark, sf_dir, "dataset_split"), f)


# identity, reruns, records


def latest_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "transcription_results").select("result_id", "ingested_at", "run_id", "isrc")
    return results.latest(t, "result_id", "ingested_at").select("result_id", "ingested_at", "isrc")


def latest_per_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last finished result of each file, model and implementation."""
    r = _results(spark, sf_dir, *sinks.KEY, "finished_at", "error").where("error IS NULL")
    return r.groupBy(*sinks.KEY).agg(F.max(F.struct("finished_at", "result_id")).alias("m")).select(*sinks.KEY, F.col("m.result_id").alias("result_id"))


def skip_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the openai backend hasn't finished with large-v3."""
    done = _results(spark, sf_dir, "path", "model_name", "whisper_implementation", "error").where("error IS NULL AND model_name = 'large-v3' AND whisper_implementation = 'openai'")
    return results.unfinished(_files(spark, sf_dir).where("length > 0").select("path"), done, ["path"])


def json_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records through their JSON form and back."""
    r = _wide(spark, sf_dir, *RECORD.names, "error").where("error IS NULL")
    back = r.select("result_id", F.from_json(F.to_json(F.struct(*RECORD.names), {"ignoreNullFields": "false"}), RECORD).alias("j"))
    return back.select("result_id", "j.full_text", F.size("j.segments").cast("bigint").alias("n_segments"), "j.model_name", "j.audio_type", "j.alignment_model_load_time", "j.transcription_time", "j.detected_language")


def append_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results appended to a table twice over; the second time adds nothing."""
    at = folder(spark, "append")
    r = table(spark, sf_dir, "transcription_results").select("result_id", "path", "model_name", "whisper_implementation")
    for _ in range(2):
        sinks.append_once(r, at, key=("result_id",), key_decides=True)
    return spark.read.parquet(at).groupBy("model_name", "whisper_implementation").agg(F.count("*").alias("n"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings taken in as a stream, each once, then counted per implementation."""
    at = folder(spark, "stream")
    path = f"{sf_dir}/transcription_timings.parquet"
    stream = ingest.new_rows(spark, path, spark.read.parquet(path).schema).select("timing_id", "whisper_implementation", "audio_type")
    ingest.ingest(stream, f"{at}/table", f"{at}/checkpoint", ("timing_id",), ("whisper_implementation",))
    return spark.read.parquet(f"{at}/table").groupBy("whisper_implementation", "audio_type").agg(F.count("*").alias("n"))


# word error rate


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result against the first whisperx large-v3 result of the same file."""
    r = _wide(spark, sf_dir, "path", "model_name", "whisper_implementation", "full_text", "error").where("error IS NULL AND full_text IS NOT NULL")
    first = r.where("model_name = 'large-v3' AND whisper_implementation = 'whisperx'").groupBy("path").agg(F.min(F.struct("result_id", "full_text")).alias("m"))
    ref = first.select("path", F.col("m.result_id").alias("reference_id"), F.col("m.full_text").alias("reference"))
    both = r.join(ref, "path").where("result_id <> reference_id")
    return both.select("result_id", "reference_id", "model_name", "whisper_implementation", wer.word_errors(F.col("reference"), F.col("full_text")).alias("e")).select("result_id", "reference_id", "model_name", "whisper_implementation", "e.edits", "e.reference_words")


def wer_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir).select("result_id", "reference_id", "edits", "reference_words", F.round(wer.error_rate(F.col("edits"), F.col("reference_words")), 6).alias("wer"))


def wer_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits over reference words, summed per model and implementation."""
    e = _errors(spark, sf_dir).groupBy("model_name", "whisper_implementation").agg(F.sum("edits").alias("edits"), F.sum("reference_words").alias("reference_words"))
    return e.select("*", F.round(wer.error_rate(F.col("edits"), F.col("reference_words")), 6).alias("wer"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            p3_found, p3_folder_coverage, isrc_from_path, path_join, file_stem, audio_type_map, audio_extension_filter, wav_union_mp3, folders_without_audio, first_match,
            unavailable_models, open_segments, segments_flatten, segments_count, segment_projection, transcript_full_text, segment_clock, report_lines, chunk_30s, batch_assign,
            tree_scan, tree_single_file, tree_without_audio, tree_separate, stub_transcribe, stub_error_capture, transcribe_record, stored_failures, timing_display, run_summary, run_summary_empty, realtime_factor, transcription_speed, alignment_share, language_share, train_test_split,
            model_backend_matrix, experiment_grid, other_models, grid_coverage, missing_versions, latest_result, latest_per_work, skip_finished, json_record, append_twice, stream_ingest,
            wer_per_item, wer_corpus,
        )
    }
