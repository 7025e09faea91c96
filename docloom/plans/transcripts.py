"""Registered transcript queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import transcripts as tr
from docloom.plans.base import Registry, Tables
from docloom.sources.tables import segments as to_segments

R = Registry()

SEG = """SELECT conv_id AS video_id, turn AS seq, CAST(turn AS DOUBLE) * CAST(2.3 AS DOUBLE) AS start,
   CAST(length(text) AS DOUBLE) / CAST(15 AS DOUBLE) AS duration, text FROM {conversations}"""
LINKS = """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'https://www.youtube.com/watch?v=v' || CAST(conv_id AS VARCHAR(20)) || '&t=3'
   WHEN 1 THEN 'https://youtu.be/v' || CAST(conv_id AS VARCHAR(20)) || '?si=x' ELSE 'v' || CAST(conv_id AS VARCHAR(20)) END AS url FROM {conversations}"""
TRACKS = """SELECT source || '/' || CAST(doc_id % 40 AS VARCHAR(20)) AS video_id, lang AS language_code, doc_id AS transcript_id FROM {documents} WHERE doc_id % 40 < 38 OR lang <> 'en'"""
NOTES = """SELECT doc_id, '2025-01-0' || CAST(1 + doc_id % 9 AS VARCHAR(1)) || '-tema-' || CAST(doc_id AS VARCHAR(20)) || '-session.md' AS file,
   text || CASE WHEN doc_id % 2 = 0 THEN ' Blockers: N/A' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ' ## Decisiones tomadas' ELSE '' END AS text FROM {documents}"""


@R.query("video_id", "SELECT conv_id, turn, 'v' || conv_id AS video_id FROM conversations")
def video_id(t: Tables) -> DataFrame:
    return tr.video_id(t.sql(LINKS)).select("conv_id", "turn", "video_id")


@R.query("read_segments", """
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS seq FROM documents)
SELECT doc_id, seq, CAST(seq AS DOUBLE) * CAST(2.5 AS DOUBLE) AS start, md5(text) AS h FROM s""")
def read_segments(t: Tables) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("text"), (i * F.lit(2.5)).alias("start"), F.lit(2.5).alias("duration")))
    docs = t.documents.select(F.col("doc_id").alias("video_id"), F.lit("").alias("language"), F.col("lang").alias("language_code"),
                              F.lit(False).alias("is_generated"), lines.alias("transcript"))
    return to_segments(docs).select(F.col("video_id").alias("doc_id"), "seq", "start", F.md5("text").alias("h"))


_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"


@R.query("transcript_text", """
SELECT conv_id AS video_id, turn // 10000 AS part_no, md5(string_agg(text, ' ' ORDER BY turn)) AS h, CAST(sum(""" + _WORDS + """) AS BIGINT) AS word_count,
  count(*) AS snippet_count FROM conversations GROUP BY 1, 2""")
def transcript_text(t: Tables) -> DataFrame:
    return tr.transcript_text(t.sql(SEG)).select("video_id", "part_no", F.md5("text").alias("h"), "word_count", "snippet_count")


@R.query("speech_rate", """
WITH a AS (SELECT video_id, CAST(sum(""" + _WORDS + """) AS BIGINT) AS n_words, max(start + duration) AS seconds FROM seg GROUP BY 1)
SELECT video_id, n_words, round(n_words / (seconds / 60), 6) AS words_per_minute, n_words / (seconds / 60) BETWEEN 50 AND 200 AS usual FROM a""", seg=SEG)
def speech_rate(t: Tables) -> DataFrame:
    return tr.speech_rate(t.sql(SEG)).select("video_id", "n_words", F.round("words_per_minute", 6).alias("words_per_minute"), "usual")


@R.query("language_pick", """
WITH r AS (SELECT *, CASE language_code WHEN 'es' THEN 1 WHEN 'en' THEN 2 END AS p FROM tracks),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY p, transcript_id) AS rn FROM r WHERE p IS NOT NULL)
SELECT v.video_id, b.language_code, b.transcript_id, CASE WHEN b.video_id IS NULL THEN 'no transcript in the wanted languages' ELSE '' END AS error
FROM (SELECT DISTINCT video_id FROM tracks) v LEFT JOIN b ON b.video_id = v.video_id AND b.rn = 1""", tracks=TRACKS)
def language_pick(t: Tables) -> DataFrame:
    return tr.language_pick(t.sql(TRACKS), ("es", "en"))


def _srt(x: str) -> str:
    return (f"lpad(CAST(CAST(floor({x} / 3600) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(({x} % 3600) / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' || "
            f"lpad(CAST(CAST(floor({x} % 60) AS BIGINT) AS VARCHAR), 2, '0') || ',' || lpad(CAST(CAST(floor(({x} % 1) * 1000) AS BIGINT) AS VARCHAR), 3, '0')")


@R.query("srt_cues", f"SELECT video_id, seq + 1 AS cue_no, {_srt('start')} || ' --> ' || {_srt('(start + duration)')} AS timing, md5(text) AS h FROM seg", seg=SEG)
def srt_cues(t: Tables) -> DataFrame:
    return tr.srt_cues(t.sql(SEG)).select("video_id", "cue_no", "timing", F.md5("text").alias("h"))


LONG = """SELECT conv_id AS video_id, turn AS seq, CAST(turn * 997 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS start, CAST(1 AS DOUBLE) AS duration, text FROM {conversations}"""


@R.query("timestamp_lines", """
SELECT video_id, seq, '[' || CASE WHEN s // 60 < 10 THEN '0' ELSE '' END || s // 60 || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || '] ' || text AS line
FROM (SELECT *, seq * 997 AS s FROM seg)""", seg=LONG)
def timestamp_lines(t: Tables) -> DataFrame:
    return tr.timestamp_lines(t.sql(LONG))


@R.query("transcript_chunks", """
WITH r AS (SELECT *, sum(length(text)) OVER (PARTITION BY video_id ORDER BY seq) - length(text) AS before FROM seg)
SELECT video_id, CAST(before // 500 AS BIGINT) AS chunk_no, min(seq) AS first_seq, md5(string_agg(text, ' ' ORDER BY seq)) AS h FROM r GROUP BY 1, 2""", seg=SEG)
def transcript_chunks(t: Tables) -> DataFrame:
    return tr.transcript_chunks(t.sql(SEG), 500).select("video_id", "chunk_no", "first_seq", F.md5("text").alias("h"))


KINDS = """SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN 'summary' WHEN 1 THEN 'keypoints' WHEN 2 THEN 'technical' WHEN 3 THEN 'educational' ELSE 'other' END AS kind FROM {documents}"""


@R.query("prompt_rows", """
SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'Extrae' WHEN doc_id % 5 = 2 THEN 'Analiza esta transcripción' WHEN doc_id % 5 = 3 THEN 'Analiza este contenido'
  ELSE 'Analiza la siguiente' END AS starts, md5(substr(text, 1, 8000) || '... (continúa)' || chr(10)) AS h FROM kinds""", kinds=KINDS)
def prompt_rows(t: Tables) -> DataFrame:
    rows = tr.prompt_rows(t.sql(KINDS))
    starts = F.regexp_extract("prompt", "^(Extrae|Analiza esta transcripción|Analiza este contenido|Analiza la siguiente)", 1)
    return rows.select("doc_id", starts.alias("starts"), F.md5(F.regexp_replace("prompt", r"(?s)^.*?Transcripción:\n", "")).alias("h"))


@R.query("prompt_rows_custom", "SELECT doc_id, md5('Resume.' || chr(10) || chr(10) || 'Transcripción:' || chr(10) || text) AS h FROM documents")
def prompt_rows_custom(t: Tables) -> DataFrame:
    return tr.prompt_rows(t.documents, custom="Resume.").select("doc_id", F.md5("prompt").alias("h"))


@R.query("required_sections", """
WITH s AS (SELECT unnest(['Qué estamos construyendo', 'Qué FUNCIONÓ', 'Qué NO funcionó', 'Qué NO se ha intentado', 'Estado de archivos', 'Decisiones tomadas', 'Blockers', 'Próximo paso exacto']) AS section)
SELECT file, '2025-01-0' || (1 + doc_id % 9) AS date, 'tema-' || doc_id AS title, section FROM notes CROSS JOIN s WHERE NOT contains(text, section)""", notes=NOTES)
def required_sections(t: Tables) -> DataFrame:
    return tr.required_sections(t.sql(NOTES))
