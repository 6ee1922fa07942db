"""Queries of the training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import canonical_language
from ..sources.tables import sound_spans, table
from . import language, leaks, neardup, packing, pieces, quantiles, subjects, tokens

PERMILLE = (10, 250, 500, 750, 900, 990)


def _budget(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Totals by all keys together, by each alone and over all; ``level`` names the keys in use."""
    sets = [[F.col(k) for k in keys], *[[F.col(k)] for k in keys], []]
    level = F.concat_ws("+", *[F.when(F.grouping(k) == 0, k) for k in keys])
    return counted.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        level.alias("level"), F.count("*").alias("texts"), F.count_if("usable").alias("usable_texts"),
        F.coalesce(F.sum(F.when(F.col("usable"), F.col("tokens"))), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(F.col("usable"), F.col("chars"))), F.lit(0)).alias("chars"),
    )


def _result_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each result once, with its tokens and the labels that its budget goes by.

    Deliveries of a result have the same content, so they fall into one group of hashed keys.
    """
    count = tokens.token_counter(spark)
    t = table(spark, sf_dir, "transcription_results").select(
        "result_id", "whisper_implementation", F.coalesce(canonical_language(F.col("detected_language")), F.lit("?")).alias("language"), "audio_type",
        F.coalesce(F.col("full_text").rlike(r"[\p{L}\p{N}]"), F.lit(False)).alias("usable"), F.length("full_text").alias("chars"), count(F.col("full_text")).alias("tokens"),
    )
    once = t.groupBy("result_id", "whisper_implementation", "language", "audio_type")
    return once.agg(F.max("usable").alias("usable"), F.max("chars").alias("chars"), F.max("tokens").alias("tokens"))


def p1_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all results by implementation, language (as labelled) and audio type.

    Texts without a word are not usable; a result that was delivered twice counts once.
    """
    return _budget(_result_tokens(spark, sf_dir), ["whisper_implementation", "language", "audio_type"])


def p1_result_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every result."""
    return _result_tokens(spark, sf_dir).select("result_id", "tokens")


def p1_token_budget_mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all results by implementation, language as problem 2 finds it and audio type.

    Results without a language (too short, or written in none that is known) are under ``?``.
    """
    found = _result_languages(spark, sf_dir).where("seg_no = -1").groupBy("result_id").agg(F.max("lang").alias("mended"))
    t = _result_tokens(spark, sf_dir).drop("language").join(found, "result_id", "left").withColumn("language", F.coalesce("mended", F.lit("?")))
    return _budget(t, ["whisper_implementation", "language", "audio_type"])


def p1_token_budget_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by source, language (problem 2) and domain: the subject of most of their words (problem 9).

    ``?`` stands for no language, ``none`` for no subject.
    """
    count = tokens.token_counter(spark)
    t = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False)).alias("usable"), F.length("text").alias("chars"), count(F.col("text")).alias("tokens"))
    spoken = _document_languages(spark, sf_dir, False).select("doc_id", F.col("lang").alias("language"))
    about = _shares(spark, sf_dir).groupBy("doc_id").agg(F.max(F.struct("words", "subject")).alias("s")).select("doc_id", F.col("s.subject").alias("domain"))
    t = t.join(spoken, "doc_id", "left").join(about, "doc_id", "left").na.fill({"language": "?", "domain": "none"})
    return _budget(t, ["source", "language", "domain"])


def p1_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = tokens.token_counter(spark)
    return table(spark, sf_dir, "documents").select("doc_id", count(F.col("text")).alias("tokens"))


def _result_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "transcription_results")
    told = r.select(F.struct("result_id", canonical_language(F.col("detected_language")).alias("label")).alias("k"), "full_text", F.col("segments.text").alias("texts"))
    found = language.languages(told, language.train(r), "k", "full_text", F.col("texts"))
    return found.select("k.result_id", "k.label", "seg_no", "lang", "confidence")


#: The languages that the statement of problem 2 lists (fixed values).
STATED = ("en", "es", "pt", "fr", "de", "it", "nl", "sv", "pl", "tr", "ru", "ja")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose label is missing or wrong, and segments in another language, for the languages of the statement."""
    wrong = (F.col("seg_no") >= 0) | F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return _result_languages(spark, sf_dir).where(wrong & F.col("lang").isin(*STATED)).select("result_id", "seg_no", "lang").distinct()


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every result of 20 words or more, and of its segments in another language."""
    return _result_languages(spark, sf_dir).select("result_id", "seg_no", "lang", F.round("confidence", 4).alias("confidence")).distinct()


def _document_languages(spark: SparkSession, sf_dir: str, lines: bool) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = language.train(docs, "doc_id", "text", "lang")
    return language.languages(docs, machine, "doc_id", "text", F.split("text", "\\R") if lines else None)


def p2_document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document of 20 words or more, and of its lines in another language."""
    return _document_languages(spark, sf_dir, True).select("doc_id", "seg_no", "lang", F.round("confidence", 4).alias("confidence"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.Similar(table(spark, sf_dir, "transcription_results")).all_pairs()


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.Similar(table(spark, sf_dir, "transcription_results")).classes()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "transcription_results")
    return pieces.cut_items(r, "result_id", sound_spans(F.col("segments")), 6000, names=("piece_no", "start_cs", "end_cs")).distinct()


def p5_pause_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 60 seconds that are cut in the longest pauses."""
    r = table(spark, sf_dir, "transcription_results")
    return pieces.cut_items(r, "result_id", sound_spans(F.col("segments")), 6000, boundary="gap", names=("piece_no", "start_cs", "end_cs")).distinct()


def _timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "transcription_timings").select("timing_id", F.to_date("logged_at").alias("day"), "model_name", "whisper_implementation", "audio_type", "transcription_time").distinct()


GROUPS = ["model_name", "whisper_implementation", "audio_type"]


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of timings per model, implementation and audio type, of each day and of all days.

    The frequencies of the days add up to those of the whole period, whose ``day`` is NULL.
    """
    daily = quantiles.frequencies(_timings(spark, sf_dir), ["day", *GROUPS], F.col("transcription_time"), partial=True)
    return quantiles.percentiles(daily, PERMILLE, levels=[["day", *GROUPS], GROUPS])


def p6_combined_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from daily frequency tables of 3 significant digits, combined over all days."""
    daily = quantiles.frequencies(_timings(spark, sf_dir), ["day", *GROUPS], F.col("transcription_time"), digits=3)
    return quantiles.percentiles(quantiles.combine(daily.drop("day")), PERMILLE)


def p6_result_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the results' transcription times."""
    t = table(spark, sf_dir, "transcription_results").select("result_id", *GROUPS, "transcription_time").distinct()
    return quantiles.percentiles(quantiles.frequencies(t, GROUPS, F.col("transcription_time")), PERMILLE)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = tokens.token_counter(spark)
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs.select("doc_id", count(F.col("text")).alias("n_tokens")), "doc_id", "n_tokens", max_cost=packing.COST, expected_rows=docs.count())


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of 12 words of an item at distance 0 (the statement allows no edit)."""
    return p8_leaks(spark, sf_dir).where("edits = 0").select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item with a passage of 12 words that differs by one word edit at most."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return subjects.shares(docs, subjects.mine(docs, table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(spark, sf_dir).where(F.col("share") >= subjects.SHARE).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents about each subject, and words about it, over the whole corpus."""
    s = _shares(spark, sf_dir)
    return s.groupBy("subject").agg(F.count_if(F.col("share") >= subjects.SHARE).alias("documents"), F.sum("words").alias("words"), F.round(F.sum(F.col("words") * F.col("confidence")) / F.sum("words"), 4).alias("confidence"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_token_budget, p1_result_tokens, p1_token_budget_mended, p1_token_budget_documents, p1_document_tokens, p2_found, p2_languages, p2_document_languages, p4_found, p4_classes, p5_found, p5_pause_cuts,
            p6_percentiles, p6_combined_days, p6_result_percentiles, p7_packing, p7_fill, p8_found, p8_leaks, p9_found, p9_composition,
        )
    }


def _percentile_sql(key: str, name: str, day: str | None = None) -> str:
    ps = ", ".join(f"({p})" for p in PERMILLE)
    groups = ["day"] * bool(day) + GROUPS
    g = ", ".join(groups)
    own = f", CAST({day} AS DATE) AS day" if day else ""
    f = f"SELECT {g}, v FROM t WHERE v > 0 AND isfinite(v)"
    if day:
        f += f" UNION ALL SELECT NULL, {', '.join(GROUPS)}, v FROM t WHERE v > 0 AND isfinite(v)"
    return f"""
WITH t AS (SELECT DISTINCT {key}{own}, model_name, whisper_implementation, audio_type, transcription_time AS v FROM {name}),
f AS ({f}),
r AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY v) AS k, count(*) OVER (PARTITION BY {g}) AS n FROM f)
SELECT {g}, p.permille::INT AS permille, v AS value, n::BIGINT AS n
FROM r, (VALUES {ps}) p(permille) WHERE k = greatest(1, (n * p.permille + 999) // 1000)
"""


_PAIRS = r"""
WITH t AS (SELECT DISTINCT result_id, regexp_extract_all(lower(full_text), '[\p{L}\p{N}]+') AS w FROM transcription_results WHERE full_text IS NOT NULL),
k AS (SELECT result_id, w FROM t WHERE len(w) >= 20),
s AS (SELECT DISTINCT result_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT result_id, w, unnest(range(1, len(w) - 1)) AS i FROM k)),
n AS (SELECT result_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.result_id AS x, b.result_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.result_id < b.result_id GROUP BY 1, 2)
SELECT x AS result_id_a, y AS result_id_b FROM c JOIN n p ON p.result_id = x JOIN n q ON q.result_id = y WHERE 5 * m >= 3 * (p.n + q.n - m)
"""

#: One row a result: the least result of its class over any number of links, and its own links to other sets and to copies.
_CLASSES = r"""
WITH RECURSIVE t AS (SELECT DISTINCT result_id, regexp_extract_all(lower(full_text), '[\p{L}\p{N}]+') AS w FROM transcription_results WHERE full_text IS NOT NULL),
k AS (SELECT result_id, w FROM t WHERE len(w) >= 20),
s AS (SELECT DISTINCT result_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT result_id, w, unnest(range(1, len(w) - 1)) AS i FROM k)),
l AS (SELECT result_id, list(g ORDER BY g) AS own FROM s GROUP BY 1),
m AS (SELECT result_id, min(result_id) OVER (PARTITION BY own) AS rep, count(*) OVER (PARTITION BY own) - 1 AS copies, len(own) AS n FROM l),
e AS (SELECT s.result_id, g FROM s JOIN m ON m.result_id = s.result_id AND m.rep = m.result_id),
c AS (SELECT a.result_id AS x, b.result_id AS y, count(*) AS m FROM e a JOIN e b ON a.g = b.g AND a.result_id < b.result_id GROUP BY 1, 2),
p AS (SELECT x, y FROM c JOIN m u ON u.result_id = x JOIN m v ON v.result_id = y WHERE 5 * c.m >= 3 * (u.n + v.n - c.m)),
b AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r AS (SELECT DISTINCT x, x AS y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y),
d AS (SELECT x, min(y) AS least FROM r GROUP BY x),
n AS (SELECT x, count(*) AS links FROM b GROUP BY x)
SELECT m.result_id, coalesce(d.least, m.rep) AS class_id, coalesce(n.links, 0) + m.copies AS n_links FROM m LEFT JOIN d ON d.x = m.rep LEFT JOIN n ON n.x = m.rep
"""

_PIECES = """
WITH RECURSIVE x AS (SELECT DISTINCT ON (result_id) result_id, segments FROM transcription_results WHERE segments IS NOT NULL),
u AS (SELECT result_id, unnest(segments) AS g FROM x),
v AS (SELECT result_id, CAST(round(g."start" * 100) AS BIGINT) AS s, CAST(round(g."end" * 100) AS BIGINT) AS e FROM u WHERE g."start" IS NOT NULL AND g."end" IS NOT NULL),
l AS (SELECT result_id, list(s ORDER BY s, e) AS ss, list(e ORDER BY s, e) AS ee FROM v WHERE e > s GROUP BY result_id),
f AS (SELECT * FROM l WHERE list_max(ee) - ss[1] > 6000),
p AS (
  SELECT result_id, ss, ee, 1::BIGINT AS piece_no, 1::BIGINT AS i, 1 + len([k FOR k IN range(2, len(ss) + 1) IF list_max(ee[1:k]) - ss[1] <= 6000]) AS j FROM f
  UNION ALL
  SELECT result_id, ss, ee, piece_no + 1, b, b + len([k FOR k IN range(b + 1, len(ss) + 1) IF list_max(ee[b:k]) - ss[b] <= 6000])
  FROM (SELECT *, CASE WHEN j > i AND greatest(ee[j], ee[j + 1]) - ss[j] <= 6000 THEN j ELSE j + 1 END AS b FROM p WHERE j < len(ss))
)
SELECT result_id, piece_no, ss[i] AS start_cs, list_max(ee[i:j]) AS end_cs FROM p
"""

#: Boundaries by silence, then order; ``c`` is the first segment of each segment's cluster so far.
_PAUSES = """
WITH RECURSIVE x AS (SELECT DISTINCT ON (result_id) result_id, segments FROM transcription_results WHERE segments IS NOT NULL),
u AS (SELECT result_id, unnest(segments) AS g FROM x),
v AS (SELECT result_id, CAST(round(g."start" * 100) AS BIGINT) AS s, CAST(round(g."end" * 100) AS BIGINT) AS e FROM u WHERE g."start" IS NOT NULL AND g."end" IS NOT NULL),
l AS (SELECT result_id, list(s ORDER BY s, e) AS ss, list(e ORDER BY s, e) AS ee FROM v WHERE e > s GROUP BY result_id),
f AS (
  SELECT *, [CASE WHEN k > 1 AND greatest(ee[k - 1], ee[k]) - ss[k - 1] <= 6000 THEN k - 1 ELSE k END FOR k IN range(1, len(ss) + 1)] AS carry,
    [b.i FOR b IN list_sort([{'gap': ss[k + 1] - list_max(ee[1:k]), 'i': k} FOR k IN range(1, len(ss))])] AS o
  FROM l WHERE list_max(ee) - ss[1] > 6000
),
m AS (
  SELECT result_id, ss, ee, carry, o, range(1, len(ss) + 1) AS c, 1 AS t FROM f
  UNION ALL
  SELECT result_id, ss, ee, carry, o, CASE WHEN greatest(top, ee[carry[a]]) - ss[carry[a]] <= 6000 THEN [CASE WHEN x = i + 1 THEN a ELSE x END FOR x IN c] ELSE c END, t + 1
  FROM (SELECT *, list_max([ee[k] FOR k IN range(1, len(ss) + 1) IF c[k] = a OR c[k] = i + 1]) AS top FROM (SELECT *, o[t] AS i, c[o[t]] AS a FROM m WHERE t <= len(o)))
),
d AS (SELECT * FROM m WHERE t = len(o) + 1),
p AS (SELECT result_id, ss, ee, carry, c, unnest(list_sort(list_distinct(c))) AS a FROM d)
SELECT result_id, row_number() OVER (PARTITION BY result_id ORDER BY a) AS piece_no, ss[carry[a]] AS start_cs, greatest(ee[carry[a]], list_max([ee[k] FOR k IN range(1, len(ss) + 1) IF c[k] = a])) AS end_cs FROM p
"""

_COMBINED = f"""
WITH t AS (SELECT DISTINCT timing_id, CAST(logged_at AS DATE) AS day, model_name, whisper_implementation, audio_type, transcription_time AS v FROM transcription_timings),
f AS (SELECT *, pow(10.0, floor(log10(v)) - 2) AS step FROM t WHERE v > 0 AND isfinite(v)),
d AS (SELECT model_name, whisper_implementation, audio_type, round(v / step) * step AS v FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY model_name, whisper_implementation, audio_type ORDER BY v) AS k, count(*) OVER (PARTITION BY model_name, whisper_implementation, audio_type) AS n FROM d)
SELECT model_name, whisper_implementation, audio_type, p.permille::INT AS permille, v AS value, n::BIGINT AS n
FROM r, (VALUES {", ".join(f"({p})" for p in PERMILLE)}) p(permille) WHERE k = greatest(1, (n * p.permille + 999) // 1000)
"""


#: Broken encodings and entities aren't mended here; on the tables at hand no passage of 12 words depends on it.
_LEAKED = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '\pL+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '\pL+') AS w FROM eval_items WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM e)),
c AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM c JOIN i USING (g)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p8_found": _LEAKED,
        "p4_found": _PAIRS,
        "p4_classes": _CLASSES,
        "p5_found": _PIECES,
        "p5_pause_cuts": _PAUSES,
        "p6_percentiles": _percentile_sql("timing_id", "transcription_timings", "logged_at"),
        "p6_combined_days": _COMBINED,
        "p6_result_percentiles": _percentile_sql("result_id", "transcription_results"),
    }
