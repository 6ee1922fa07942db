"""Record types and fixed domains of transcription experiments."""

from __future__ import annotations

from pyspark.sql import types as T

#: Audio versions by the stem of the file that holds them (fixed values).
AUDIO_TYPES = {"audio": "regular", "demucs_base": "demucs_base", "demucs_ft": "demucs_ft", "spleeter_11": "spleeter_11", "spleeter_16": "spleeter_16"}

#: Names of the transcription backends (fixed values).
IMPLEMENTATIONS = ("openai", "hf-sequential", "hf-chunked", "faster-whisper-sequential", "faster-whisper-chunked", "whisperx")

SEGMENT = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])

#: The persisted record, in the order in which it is exported.
RECORD = T.StructType(
    [
        T.StructField("full_text", T.StringType()),
        T.StructField("segments", T.ArrayType(SEGMENT)),
        T.StructField("model_name", T.StringType()),
        T.StructField("whisper_implementation", T.StringType()),
        T.StructField("audio_type", T.StringType()),
        T.StructField("alignment_model_load_time", T.DoubleType()),
        T.StructField("transcription_time", T.DoubleType()),
        T.StructField("detected_language", T.StringType()),
    ]
)

#: A record with its identity and failure, as stored.
RESULT = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("isrc", T.StringType()), T.StructField("path", T.StringType()), *RECORD.fields, T.StructField("error", T.StringType())])

#: One row per separated file.
SEPARATION = T.StructType([T.StructField("isrc", T.StringType()), T.StructField("path", T.StringType()), T.StructField("output_path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("separation_time", T.DoubleType()), T.StructField("error", T.StringType())])
