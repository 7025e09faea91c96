"""Transcript operators over ``segments(video_id, seq, start, duration, text, ...)``.

``seq`` is the place of a snippet in its transcript, from 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.ordered import block_of, running_total

PART = 10_000  # snippets per text part: a long recording stays several values of bounded size
LANGUAGES = ("es", "es-ES", "es-MX", "en")  # fixed value: default order of preference
PROMPT_CHARS = 8000  # fixed value: characters of the transcript that a standard prompt quotes

# The standard prompts; the transcript follows each of them.
PROMPTS = {
    "summary": """Analiza la siguiente transcripción de video de YouTube y proporciona:

1. **Resumen Ejecutivo** (2-3 párrafos): Resumen conciso del contenido principal
2. **Puntos Clave** (5-7 puntos): Ideas principales organizadas por importancia
3. **Conceptos Destacados**: Terminología o conceptos importantes mencionados
4. **Aplicación Práctica**: Cómo se puede aplicar esta información

Transcripción:
""",
    "keypoints": """Extrae los puntos clave de esta transcripción de YouTube en formato de lista:

Transcripción:
""",
    "technical": """Analiza esta transcripción de video técnico y proporciona:

1. **Stack Tecnológico**: Tecnologías, herramientas o frameworks mencionados
2. **Arquitectura**: Patrones arquitectónicos o de diseño discutidos
3. **Mejores Prácticas**: Recomendaciones o principios mencionados
4. **Casos de Uso**: Ejemplos prácticos o aplicaciones

Transcripción:
""",
    "educational": """Analiza este contenido educativo y proporciona:

1. **Objetivo de Aprendizaje**: Qué se enseña
2. **Prerequisitos**: Conocimientos previos necesarios
3. **Conceptos Principales**: Ideas centrales explicadas
4. **Ejemplos Prácticos**: Ejercicios o demos mencionados
5. **Recursos Adicionales**: Referencias o links mencionados

Transcripción:
""",
}


def video_id(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("video_id", T.video_id(F.col(url)))


def _in_order(sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), sep)


def transcript_text(segments: DataFrame) -> DataFrame:
    """Running text per video in parts of ``PART`` snippets: ``(video_id, part_no, text, word_count, snippet_count)``.

    Joining the parts by one blank gives the whole text, and the counts add up over the parts.
    """
    part = F.floor(F.col("seq") / PART).cast("long")
    return segments.groupBy("video_id", part.alias("part_no")).agg(
        _in_order(" ").alias("text"), F.sum(T.words(F.col("text"))).alias("word_count"), F.count(F.lit(1)).alias("snippet_count"))


def speech_rate(segments: DataFrame) -> DataFrame:
    """Words per minute of each video, and whether that is the usual 50 to 200."""
    rate = F.col("n_words") / (F.col("seconds") / 60)
    return (segments.groupBy("video_id").agg(F.sum(T.words(F.col("text"))).alias("n_words"), F.max(F.col("start") + F.col("duration")).alias("seconds"))
            .withColumn("words_per_minute", F.when(F.col("seconds") > 0, rate))
            .withColumn("usual", F.coalesce(F.col("words_per_minute").between(50, 200), F.lit(False))))


def language_pick(transcripts: DataFrame, prefs: Sequence[str] = LANGUAGES, tie: str = "transcript_id") -> DataFrame:
    """One transcript per video: the first language of the list that it has; ``error`` tells when there is none."""
    place = F.array_position(F.array(*[F.lit(p) for p in prefs]), F.col("language_code"))
    key = F.when(place > 0, F.struct(place.alias("p"), F.col(tie).alias("t")))
    out = transcripts.groupBy("video_id").agg(F.min_by(F.struct("language_code", tie), key).alias("_b"))
    return out.select("video_id", "_b.language_code", F.col(f"_b.{tie}").alias(tie),
                      F.when(F.col("_b").isNull(), F.lit("no transcript in the wanted languages")).otherwise("").alias("error"))


def _srt(seconds: Column) -> Column:
    """``HH:MM:SS,mmm`` with the milliseconds cut from the double, not rounded."""
    whole = lambda c: F.floor(c).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", whole(seconds / 3600), whole((seconds % 3600) / 60), whole(seconds % 60), whole((seconds % 1) * 1000))


def srt_cues(segments: DataFrame) -> DataFrame:
    """Subtitle cues, numbered from 1.  The number is the snippet's place, so nothing is shuffled."""
    s, e = F.col("start").cast("double"), F.col("start").cast("double") + F.col("duration").cast("double")
    return segments.select("video_id", (F.col("seq") + 1).alias("cue_no"), F.concat(_srt(s), F.lit(" --> "), _srt(e)).alias("timing"), "text")


def timestamp_lines(segments: DataFrame) -> DataFrame:
    """``[MM:SS] text``; the minutes run on past 59."""
    s = F.col("start").cast("double")
    stamp = F.format_string("[%02d:%02d] ", F.floor(s / 60).cast("long"), F.floor(s % 60).cast("long"))
    return segments.select("video_id", "seq", F.concat(stamp, F.col("text")).alias("line"))


def transcript_chunks(segments: DataFrame, max_chars: int) -> DataFrame:
    """Ordered chunks: a snippet belongs to the chunk in which its first character falls, counting
    ``max_chars`` characters per chunk over the whole video.  ``(video_id, chunk_no, first_seq, text)``."""
    n = F.length("text").cast("long")
    placed = running_total(segments, ["video_id"], ["seq"], n, "_upto", block_of("seq"))
    chunk = F.floor((F.col("_upto") - n) / max_chars).cast("long")
    return placed.groupBy("video_id", chunk.alias("chunk_no")).agg(F.min("seq").alias("first_seq"), _in_order(" ").alias("text"))


def prompt_rows(transcripts: DataFrame, kind: str = "kind", custom: str | None = None, prompts: Mapping[str, str] = PROMPTS,
                max_chars: int | None = PROMPT_CHARS) -> DataFrame:
    """Adds ``prompt``: the template of the row's kind (``summary`` for unknown kinds) with the first ``max_chars``
    characters of the text (None: all of it, without the sign that it goes on), or a custom instruction with the whole text."""
    if custom is not None:
        return transcripts.withColumn("prompt", F.concat(F.lit(custom + "\n\nTranscripción:\n"), F.col("text")))
    head = F.lit(prompts["summary"])
    for name, value in prompts.items():
        if name != "summary":
            head = F.when(F.col(kind) == name, F.lit(value)).otherwise(head)
    if max_chars is None:
        return transcripts.withColumn("prompt", F.concat(head, F.col("text")))
    return transcripts.withColumn("prompt", F.concat(head, F.substring("text", 1, max_chars), F.lit("... (continúa)\n")))


# Sections a session note must have.
SECTIONS = ("Qué estamos construyendo", "Qué FUNCIONÓ", "Qué NO funcionó", "Qué NO se ha intentado", "Estado de archivos",
            "Decisiones tomadas", "Blockers", "Próximo paso exacto")


def required_sections(notes: DataFrame, required: Sequence[str] = SECTIONS) -> DataFrame:
    """Missing sections of each note ``(file, text)``: one row per missing name, with date and title from the file name."""
    missing = F.filter(F.array(*[F.when(~F.col("text").contains(s), F.lit(s)) for s in required]), lambda x: x.isNotNull())
    name = r"^(\d{4}-\d{2}-\d{2})-(.*)-session\.md$"
    return notes.select("file", F.regexp_extract("file", name, 1).alias("date"), F.regexp_extract("file", name, 2).alias("title"),
                        F.explode(missing).alias("section"))
