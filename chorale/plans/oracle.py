"""ANSI SQL, in DuckDB's dialect, that gives the rows of the core queries from the same tables."""

from __future__ import annotations

from ..functions.labels import LANGUAGES, PLACEHOLDERS
from ..operators.experiment import FAMILIES, MATRIX, OTHERS
from ..schema import AUDIO_TYPES

_FILES = "(SELECT path, max(isrc) AS isrc, max(audio_type) AS audio_type, max(length) AS length, max(duration_s) AS duration_s FROM audio_files GROUP BY path)"
_STEM = r"lower(regexp_extract(path, '([^/]+?)(\.[^./]+)?$', 1))"
_RESULTS = "(SELECT * FROM transcription_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at) = 1)"
_RUNS = "(SELECT DISTINCT * FROM separation_runs)"
_MATRIX = "(VALUES " + ", ".join(f"('{m}', '{f}')" for m, fs in MATRIX for f in fs) + ") AS matrix(model_name, family)"
_VERSIONS = "(VALUES " + ", ".join(f"('{t}')" for t in AUDIO_TYPES.values()) + ") AS versions(audio_type)"
_FAMILY = "regexp_replace(whisper_implementation, '-(sequential|chunked)$', '')"


def _type(other: str) -> str:
    return "CASE " + _STEM + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AUDIO_TYPES.items()) + f" ELSE '{other}' END"


def _flat(source: str, more: str = "") -> str:
    return f"SELECT result_id, CAST(i - 1 AS BIGINT) AS seg_no, segments[i].text AS text, segments[i].\"start\" AS \"start\", segments[i].\"end\" AS \"end\" FROM (SELECT result_id, segments, unnest(range(1, len(segments) + 1)) AS i FROM {source}) {more}"


def _intervals(key: str) -> str:
    return f"""
WITH x AS (SELECT {key}, unnest(segments) AS g FROM transcription_results),
i AS (SELECT DISTINCT {key}, CAST(round(g."start" * 100) AS BIGINT) AS a, CAST(round(g."end" * 100) AS BIGINT) AS z FROM x
      WHERE g."start" IS NOT NULL AND g."end" IS NOT NULL AND round(g."end" * 100) > round(g."start" * 100)),
m AS (SELECT *, max(z) OVER (PARTITION BY {key} ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
k AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY a, z) AS no FROM m),
p AS (SELECT {key}, min(a) AS a, max(z) AS z FROM k GROUP BY {key}, no),
g AS (SELECT {key}, lag(z) OVER (PARTITION BY {key} ORDER BY a) AS a, a AS z FROM p)
SELECT {key}, 'period' AS kind, a AS start_cs, z AS end_cs FROM p
UNION ALL SELECT {key}, 'gap', a, z FROM g WHERE a IS NOT NULL
"""


def _clock(x: str) -> str:
    s = f"CAST(floor({x}) AS BIGINT)"
    hms = f"printf('%d:%02d:%02d', ({s} % 86400) // 3600, ({s} % 3600) // 60, {s} % 60)"
    return f"CASE WHEN {s} < 86400 THEN {hms} WHEN {s} < 172800 THEN '1 day, ' || {hms} ELSE ({s} // 86400)::VARCHAR || ' days, ' || {hms} END"


def _language(label: str) -> str:
    clean = rf"lower(trim(regexp_replace({label}, '[\s ﻿]+', ' ', 'g')))"
    known = "MAP {" + ", ".join(f"'{n}': '{c}'" for c, names in LANGUAGES.items() for n in (c, *names)) + "}"
    head = rf"regexp_extract({clean}, '^([^-_ (]*)', 1)"
    nothing = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
    return rf"CASE WHEN {clean} IS NULL OR {clean} IN ({nothing}) OR NOT regexp_matches({clean}, '\pL') THEN NULL ELSE coalesce({known}[{clean}], {known}[{head}], 'other:' || {clean}) END"


def _speed(source: str, keys: str) -> str:
    a, t = "CAST(sum(CAST(duration_s AS DECIMAL(24, 6))) AS DOUBLE)", "CAST(sum(CAST(processing_s AS DECIMAL(24, 6))) AS DOUBLE)"
    return f"SELECT {keys}, count(*) AS files, round({t} / count(*), 6) AS mean_s, round({a} / nullif({t}, 0), 4) AS realtime FROM ({source}) WHERE duration_s IS NOT NULL AND processing_s IS NOT NULL GROUP BY {keys}"


_SUMMARY = """count(*) FILTER (error IS NULL) AS processed, count(*) FILTER (error IS NOT NULL) AS failed,
CAST(sum(CASE WHEN error IS NULL THEN CAST(separation_time AS DECIMAL(24, 6)) END) AS DOUBLE) AS total_time,
round(CAST(sum(CASE WHEN error IS NULL THEN CAST(separation_time AS DECIMAL(24, 6)) END) AS DOUBLE) / nullif(count(*) FILTER (error IS NULL), 0), 6) AS mean_time,
CAST(floor(epoch(max(finished_at))) - floor(epoch(min(finished_at))) AS BIGINT) AS elapsed_s"""


#: Word edits by dynamic programming, a row of the table for each word of the hypothesis.
_EDITS = rf"""
WITH RECURSIVE r AS (SELECT result_id, path, model_name, whisper_implementation, [w FOR w IN string_split_regex(lower(full_text), '\s+') IF w <> ''] AS words FROM {_RESULTS} WHERE error IS NULL AND full_text IS NOT NULL),
f AS (SELECT path, min(result_id) AS reference_id FROM r WHERE model_name = 'large-v3' AND whisper_implementation = 'whisperx' GROUP BY path),
p AS (SELECT h.result_id, f.reference_id, h.model_name, h.whisper_implementation, x.words AS a, h.words AS b FROM r h JOIN f ON f.path = h.path JOIN r x ON x.result_id = f.reference_id WHERE h.result_id <> f.reference_id),
d AS (
  SELECT result_id, a, b, 0 AS j, range(0, len(a) + 1) AS t FROM p
  UNION ALL
  SELECT result_id, a, b, j + 1, [i + list_min(e[1 : i + 1]) FOR i IN range(0, len(a) + 1)]
  FROM (SELECT *, list_prepend(j + 1, [least(t[i + 1] + 1, t[i] + CASE WHEN a[i] = b[j + 1] THEN 0 ELSE 1 END) - i FOR i IN range(1, len(a) + 1)]) AS e FROM d WHERE j < len(b))
),
e AS (SELECT p.result_id, reference_id, model_name, whisper_implementation, CAST(d.t[len(d.a) + 1] AS BIGINT) AS edits, CAST(len(d.a) AS BIGINT) AS reference_words FROM p JOIN d ON d.result_id = p.result_id WHERE d.j = len(d.b))
"""

_TREE = "(SELECT DISTINCT isrc, regexp_extract(path, '([^/]+)$', 1) AS name, path FROM audio_files)"


def oracle_sql() -> dict[str, str]:
    return {
        "wer_per_item": _EDITS + "SELECT result_id, reference_id, edits, reference_words, round(CAST(edits AS DOUBLE) / nullif(reference_words, 0), 6) AS wer FROM e",
        "wer_corpus": _EDITS + "SELECT model_name, whisper_implementation, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(reference_words) AS BIGINT) AS reference_words, round(CAST(sum(edits) AS DOUBLE) / nullif(sum(reference_words), 0), 6) AS wer FROM e GROUP BY 1, 2",
        "tree_scan": f"SELECT isrc, {_type('unknown')} AS audio_type, count(*) AS files, min(name) AS first_name FROM {_TREE} WHERE regexp_matches(name, '\\.(wav|mp3)$') GROUP BY 1, 2",
        "tree_single_file": f"SELECT isrc, name, {_type('regular')} AS audio_type FROM {_TREE} ORDER BY isrc || '/' || name LIMIT 1",
        "tree_without_audio": f"SELECT isrc FROM {_TREE} WHERE name IN ('audio.mp3', 'demucs_ft.wav') GROUP BY isrc HAVING count(*) FILTER (name LIKE '%.wav') = 0",
        "tree_separate": f"""
SELECT isrc, 100 + length % 400 AS frames, 2::BIGINT AS channels, 16000::BIGINT AS rate, CAST(list_sum([(k * 7919 + length) % 65536 - 32768 FOR k IN range(100 + length % 400)]) AS BIGINT) AS total, count(*) OVER () AS separated
FROM {_FILES} WHERE path LIKE '%/audio.mp3'
""",
        "transcribe_record": "SELECT doc_id, 'r0' AS run_id, 'stub-1' AS model_name, 'stub' AS whisper_implementation, 'regular' AS audio_type, 'en' AS detected_language, true AS timed, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE text <> ''",
        "stored_failures": "SELECT CASE WHEN text <> '' THEN 'record' ELSE 'failure' END AS kind, CASE WHEN text <> '' THEN '' ELSE 'ValueError: no content' END AS error, count(*) AS n FROM documents GROUP BY 1, 2",
        "timing_display": f"SELECT result_id, printf('%.2f', alignment_model_load_time / transcription_time * 100) AS shown FROM {_RESULTS} WHERE alignment_model_load_time IS NOT NULL AND transcription_time <> 0",
        "other_models": f"SELECT model_name, family, audio_type FROM (VALUES {', '.join(f"('{m}', '{f}')" for m, fs in OTHERS for f in fs)}) AS o(model_name, family), {_VERSIONS}",
        "p3_found": _intervals("result_id"),
        "p3_folder_coverage": _intervals("isrc"),
        "isrc_from_path": f"SELECT path, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS isrc FROM {_FILES}",
        "path_join": "SELECT DISTINCT '/corpus/' || isrc || '/' || output_name AS path FROM separation_runs",
        "file_stem": f"SELECT path, {_STEM} AS stem FROM {_FILES}",
        "audio_type_map": f"SELECT path, {_type('regular')} AS audio_type, {_type('unknown')} AS strict_type FROM {_FILES}",
        "audio_extension_filter": rf"SELECT path, length FROM {_FILES} WHERE regexp_matches(path, '\.(wav|mp3)$')",
        "wav_union_mp3": "SELECT DISTINCT path, 'wav' AS kind FROM audio_files WHERE path LIKE '%.wav' UNION ALL SELECT DISTINCT path, 'mp3' FROM audio_files WHERE path LIKE '%.mp3'",
        "folders_without_audio": f"SELECT DISTINCT isrc FROM dataset_split s WHERE isrc IS NOT NULL AND NOT EXISTS (SELECT 1 FROM audio_files f WHERE f.isrc = s.isrc AND f.length > 0 AND {_type('regular')} = 'demucs_ft')",
        "first_match": f"SELECT path FROM audio_files WHERE {_type('unknown')} = 'unknown' ORDER BY path LIMIT 1",
        "unavailable_models": f"SELECT result_id, model_name, family FROM (SELECT *, unnest({list(FAMILIES)}) AS family FROM {_RESULTS}) r WHERE family <> {_FAMILY} AND NOT EXISTS (SELECT 1 FROM {_MATRIX} WHERE matrix.model_name = r.model_name AND matrix.family = r.family)",
        "open_segments": f"SELECT DISTINCT result_id, CAST(len(segments) AS BIGINT) AS n FROM {_RESULTS} WHERE len([x FOR x IN segments IF x.\"start\" IS NULL OR x.\"end\" IS NULL]) > 0",
        "segments_flatten": _flat(_RESULTS),
        "segments_count": f"SELECT result_id, CAST(len(segments) AS BIGINT) AS n, segments[-1].text AS last_text FROM {_RESULTS} WHERE len(segments) > 0",
        "segment_projection": _flat(_RESULTS),
        "transcript_full_text": f"SELECT result_id, joined, coalesce(joined = full_text, false) AS verbatim FROM (SELECT result_id, full_text, coalesce(array_to_string([x.text FOR x IN segments], ' '), '') AS joined FROM {_RESULTS} WHERE segments IS NOT NULL)",
        "segment_clock": f"SELECT result_id, seg_no, {_clock('\"start\"')} AS starts, {_clock('\"end\"')} AS ends FROM ({_flat(_RESULTS)}) WHERE \"start\" >= 0 AND \"end\" >= 0",
        "report_lines": f"WITH k AS (SELECT result_id, [x FOR x IN segments IF x.\"start\" >= 0 AND x.\"end\" >= 0] AS segments FROM {_RESULTS}) SELECT result_id, seg_no, '[' || {_clock('\"start\"')} || ' -> ' || {_clock('\"end\"')} || '] ' || text AS line FROM ({_flat('k')})",
        "chunk_30s": f"SELECT result_id, CAST(floor(\"start\" / 30) AS BIGINT) AS chunk, count(*) AS n FROM ({_flat(_RESULTS)}) WHERE \"start\" >= 0 GROUP BY 1, 2",
        "batch_assign": f"SELECT path, CAST(ceil(duration_s / 30) AS BIGINT) AS chunks, CAST(ceil(ceil(duration_s / 30) / 16) AS BIGINT) AS calls FROM {_FILES} WHERE duration_s > 0",
        "stub_transcribe": """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL AND text <> ''),
x AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS t FROM l),
c AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM x)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS seg_no, t AS text, CAST(z - length(t) AS DOUBLE) / 15 AS "start", CAST(z AS DOUBLE) / 15 AS "end" FROM c
""",
        "stub_error_capture": "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'ValueError: no content' ELSE '' END AS error FROM documents",
        "run_summary": f"SELECT separator, output_name, {_SUMMARY} FROM {_RUNS} GROUP BY separator, output_name",
        "run_summary_empty": f"SELECT {_SUMMARY} FROM {_RUNS} WHERE separator = 'none'",
        "realtime_factor": _speed(f"SELECT separator, output_name, separation_time AS processing_s, duration_s FROM {_RUNS} r JOIN {_FILES} f ON f.path = '/corpus/' || r.isrc || '/audio.mp3' WHERE error IS NULL", "separator, output_name"),
        "transcription_speed": _speed(f"SELECT model_name, whisper_implementation, transcription_time - coalesce(alignment_model_load_time, 0) AS processing_s, duration_s FROM {_RESULTS} r JOIN {_FILES} f ON f.path = r.path WHERE transcription_time > 0 AND isfinite(transcription_time)", "model_name, whisper_implementation"),
        "alignment_share": f"SELECT result_id, round(alignment_model_load_time / nullif(transcription_time, 0) * 100, 4) AS percent, round(transcription_time - alignment_model_load_time, 4) AS rest_s FROM {_RESULTS} WHERE alignment_model_load_time IS NOT NULL",
        "language_share": f"SELECT language, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent FROM (SELECT coalesce({_language('detected_language')}, '?') AS language FROM {_RESULTS} WHERE error IS NULL) GROUP BY language",
        "train_test_split": f"SELECT coalesce(split, 'none') AS split, CAST(sum(k) AS BIGINT) AS results, count(*) AS recordings FROM (SELECT isrc, count(*) AS k FROM {_RESULTS} GROUP BY isrc) LEFT JOIN (SELECT isrc, max(split) AS split FROM dataset_split GROUP BY isrc) USING (isrc) GROUP BY 1",
        "model_backend_matrix": f"SELECT model_name, family FROM {_MATRIX}",
        "experiment_grid": f"SELECT model_name, family, audio_type FROM {_MATRIX}, {_VERSIONS}",
        "grid_coverage": f"""
WITH d AS (SELECT model_name, {_FAMILY} AS family, audio_type, count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NOT NULL) AS failed FROM {_RESULTS} GROUP BY 1, 2, 3)
SELECT model_name, family, audio_type, coalesce(ok, 0) AS ok, coalesce(failed, 0) AS failed FROM (SELECT * FROM {_MATRIX}, {_VERSIONS}) LEFT JOIN d USING (model_name, family, audio_type)
""",
        "missing_versions": f"SELECT s.isrc, versions.audio_type FROM (SELECT DISTINCT isrc FROM dataset_split) s, {_VERSIONS} WHERE NOT EXISTS (SELECT 1 FROM audio_files WHERE audio_files.isrc = s.isrc AND {_type('unknown')} = versions.audio_type)",
        "latest_result": "SELECT result_id, max(ingested_at) AS ingested_at, any_value(isrc) AS isrc FROM transcription_results GROUP BY result_id",
        "latest_per_work": f"SELECT path, model_name, whisper_implementation, result_id FROM {_RESULTS} WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY path, model_name, whisper_implementation ORDER BY finished_at DESC, result_id DESC) = 1",
        "skip_finished": f"SELECT path FROM {_FILES} f WHERE length > 0 AND NOT EXISTS (SELECT 1 FROM transcription_results r WHERE r.path = f.path AND r.error IS NULL AND r.model_name = 'large-v3' AND r.whisper_implementation = 'openai')",
        "json_record": f"SELECT result_id, full_text, CAST(len(segments) AS BIGINT) AS n_segments, model_name, audio_type, alignment_model_load_time, transcription_time, detected_language FROM {_RESULTS} WHERE error IS NULL",
        "append_twice": "SELECT model_name, whisper_implementation, count(DISTINCT result_id) AS n FROM transcription_results GROUP BY 1, 2",
        "stream_ingest": "SELECT whisper_implementation, audio_type, count(DISTINCT timing_id) AS n FROM transcription_timings GROUP BY 1, 2",
    }
