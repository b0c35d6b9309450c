"""Which transcript a source gets: the choice among caption tracks, and the order of captions, subtitle files and speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.operators.queueing import ranked_pick


def speaks(code: str | Column, target: str) -> Column:
    """Whether a track's code is the wanted one, or begins with the wanted language and a hyphen; 'auto' takes any."""
    c = F.lower(F.col(code) if isinstance(code, str) else code)
    if target == "auto":
        return F.lit(True)
    return F.coalesce((c == target.lower()) | F.startswith(c, F.lit(target.lower().split("-")[0] + "-")), F.lit(False))


def choose_track(tracks: DataFrame, entity: str, track: str, code: str, generated: str, target: str = "auto", prefer_manual: bool = True) -> DataFrame:
    """``entity, track, error_category``: one row per entity that has a track at all.

    Of the tracks in the wanted language the first by ``track``, manual before generated ones (the other way round
    without ``prefer_manual``). An entity whose tracks are all in other languages fails with LANGUAGE_MISMATCH.
    """
    made = F.coalesce(F.col(generated), F.lit(True))
    rows = tracks.filter(F.col(entity).isNotNull()).select(entity, track, generated, speaks(code, target).alias("__fits"))
    best = ranked_pick(rows, entity, ~F.col("__fits"), made if prefer_manual else ~made, F.col(track))
    return best.select(entity, F.when(F.col("__fits"), F.col(track)).alias(track), F.when(~F.col("__fits"), "LANGUAGE_MISMATCH").alias("error_category"))


def acquire(sources: DataFrame, captions: DataFrame, subtitles: DataFrame, speech: DataFrame, preference: str = "auto") -> DataFrame:
    """``source_id, kind, transcript_id, error_category``: where each source's transcript comes from.

    ``sources`` has ``source_id, source_type, file_path``; the others ``source_id, transcript_id``, one row per source.
    Preference 'stt' takes speech recognition alone, which needs a file. Links have captions or nothing. Local files
    take the subtitle file beside them, then (not with 'captions') speech. All else is NO_TRANSCRIPT.
    """
    if preference not in ("auto", "captions", "stt"):
        raise ValueError(f"unknown preference {preference!r}")
    named = lambda df, name: df.select("source_id", F.col("transcript_id").alias(name))
    rows = sources.select("source_id", "source_type", "file_path").distinct()
    for df, name in ((captions, "captions"), (subtitles, "subtitles"), (speech, "speech")):
        rows = rows.join(named(df, name), "source_id", "left")
    local = (F.col("source_type") == "LOCAL_FILE") & F.col("file_path").isNotNull()
    heard = F.when(F.col("file_path").isNotNull() & F.col("speech").isNotNull(), F.struct(F.lit("LOCAL_STT").alias("kind"), F.col("speech").alias("transcript_id")))
    linked = F.when(~local & F.col("captions").isNotNull(), F.struct(F.lit("CAPTIONS").alias("kind"), F.col("captions").alias("transcript_id")))
    beside = F.when(local & F.col("subtitles").isNotNull(), F.struct(F.lit("EXTERNAL_FILE").alias("kind"), F.col("subtitles").alias("transcript_id")))
    choice = {"stt": heard, "captions": F.coalesce(linked, beside), "auto": F.coalesce(linked, beside, F.when(local, heard))}[preference]
    rows = rows.withColumn("c", choice)
    return rows.select("source_id", "c.kind", "c.transcript_id", F.when(F.col("c").isNull(), "NO_TRANSCRIPT").alias("error_category"))
