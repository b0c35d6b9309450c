"""Writers. Every write goes through Spark's commit protocol: readers see all of it or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone.functions.text import file_name, strip
from turnstone.functions.timing import clock_short
from turnstone.operators import captions as C


def target_names(df: DataFrame, folder: str, title: str, source_id: str) -> DataFrame:
    """``df`` with ``target``: folder and safe title; titles that clash get the id, and a number if that clashes too.

    The bare title goes to the smallest id, which is found by aggregation; only rows of one id are numbered in a sort.
    """
    stem = file_name(F.coalesce(F.nullif(F.col(title), F.lit("")), F.col(source_id)))
    rows = df.withColumn("__stem", stem)
    again = F.row_number().over(Window.partitionBy(folder, "__stem", source_id).orderBy(F.monotonically_increasing_id()))
    rows = rows.withColumn("__again", again)
    first = rows.groupBy(F.col(folder).alias("__f"), F.col("__stem").alias("__s")).agg(F.min(source_id).alias("__first"))
    rows = rows.join(first, F.col(folder).eqNullSafe(F.col("__f")) & (F.col("__stem") == F.col("__s")))
    bare = F.col(source_id).eqNullSafe(F.col("__first"))
    named = F.when(bare, F.col("__stem")).otherwise(F.concat("__stem", F.lit("_"), file_name(source_id)))
    name = F.when(F.col("__again") == 1, named).otherwise(F.concat("__stem", F.lit("_"), file_name(source_id), F.lit("_"), F.format_string("%02d", F.col("__again") - 1)))
    return rows.withColumn("target", F.concat_ws("/", F.col(folder), name)).drop("__stem", "__again", "__f", "__s", "__first")


def write_transcripts(df: DataFrame, path: str, by: str | None = None) -> None:
    """The canonical sink: Parquet, optionally in one folder per value of ``by``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_subtitles(df: DataFrame, path: str, source_id: str = "source_id", segments: str = "segments", kind: str = "srt") -> None:
    """Subtitles as lines of text in one folder per source."""
    body = {"srt": C.to_srt, "vtt": C.to_vtt}[kind](segments)
    df.select(F.col(source_id), body.alias("value")).write.mode("overwrite").partitionBy(source_id).text(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """``manifest.json`` and ``manifest.csv`` folders."""
    manifest.write.mode("overwrite").json(f"{path}/manifest.json", ignoreNullFields=False)
    manifest.write.mode("overwrite").option("header", True).csv(f"{path}/manifest.csv")


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_stats(counters: DataFrame, path: str) -> None:
    """The one-row summary of a run as JSON."""
    counters.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)


# Labels of the page's head and captions.
_HEAD = {"id": "- **Source ID**: `", "platform": "- **Platform**: `", "uri": "- **URI**: ", "author": "- **Author / Channel**: ", "date": "- **Date**: "}
_CAPTION = {"time": "Timestamp: ", "kind": "Type: ", "description": "Description: ", "confidence": "Confidence: "}


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def to_markdown(df: DataFrame) -> DataFrame:
    """``source_id, markdown``: a page per source with its segments and their frames.

    ``df`` has ``source_id, source_type, uri, title, author, upload_date, segments`` with segments ``array<struct<start,
    end, text, speaker, frames array<struct<timestamp, frame_id, file_path, visual_type, description, confidence>>>>``.
    A frame without a file is shown by its id.
    """
    line = lambda label, c, close="": F.concat(F.lit(label), c, F.lit(close + "\n"))

    def frame(f: Column) -> Column:
        at = clock_short(f["timestamp"])
        parts = F.array_compact(F.array(
            F.concat(F.lit(_CAPTION["time"]), at), F.concat(F.lit(_CAPTION["kind"]), f["visual_type"]),
            F.concat(F.lit(_CAPTION["description"]), _given(f["description"])), F.concat(F.lit(_CAPTION["confidence"]), F.format_number(f["confidence"], 2)),
        ))
        path = F.coalesce(_given(f["file_path"]), F.concat(F.lit("frame_"), f["frame_id"]))
        return F.concat(F.lit("![Frame at "), at, F.lit("]("), path, F.lit(")\n*"), F.array_join(parts, " | "), F.lit("*\n\n"))

    def segment(s: Column) -> Column:
        who = F.coalesce(F.concat(F.lit("**"), _given(s["speaker"]), F.lit("**: ")), F.lit(""))
        body = F.concat(F.lit("### ["), clock_short(s["start"]), F.lit(" - "), clock_short(s["end"]), F.lit("]\n"), who, F.coalesce(s["text"], F.lit("")), F.lit("\n\n"))
        return F.concat(body, F.array_join(F.transform(F.coalesce(s["frames"], F.array()), frame), ""))

    optional = lambda label, c: F.coalesce(line(label, _given(F.col(c))), F.lit(""))
    head = F.concat(
        line("# ", F.coalesce(_given(F.col("title")), F.col("source_id"))), F.lit("\n"), line(_HEAD["id"], F.col("source_id"), "`"), line(_HEAD["platform"], F.coalesce("source_type", F.lit("")), "`"),
        line(_HEAD["uri"], F.coalesce("uri", F.lit(""))), optional(_HEAD["author"], "author"), optional(_HEAD["date"], "upload_date"), F.lit("\n---\n\n"),
    )
    page = F.concat(head, F.array_join(F.transform("segments", segment), ""))
    return df.select("source_id", F.concat(strip(page), F.lit("\n")).alias("markdown"))


def to_multimodal_json(df: DataFrame) -> DataFrame:
    """``source_id, json``: one object per source with its segments and their frames; nulls are kept. Columns as in ``to_markdown``."""
    segments = F.transform("segments", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["speaker"].alias("speaker"), s["frames"].alias("visual_frames")))
    frames = F.flatten(F.transform("segments", lambda s: s["frames"]))
    title = F.coalesce(_given(F.col("title")), F.col("source_id")).alias("title")
    doc = F.struct("source_id", "source_type", "uri", title, "author", "upload_date", F.size(frames).alias("visual_frame_count"), segments.alias("segments"), frames.alias("visual_frames"))
    return df.select("source_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))
