"""Readers of the files a dataset is made from."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.functions.hashing import file_id
from turnstone.functions.text import content_type
from turnstone.functions.urls import VIDEO_SUFFIXES
from turnstone.operators.captions import parse_cues
from turnstone.operators.discovery import listed_lines
from turnstone.operators.queueing import ranked_pick

# The columns of a manifest.
MANIFEST = """source_id STRING, source_type STRING, uri STRING, title STRING, output_path STRING, transcript_source STRING,
stt_backend STRING, stt_model STRING, language STRING, quality_status STRING, quality STRING, word_count BIGINT,
character_count BIGINT, duration_seconds DOUBLE, transcript_hash STRING, normalized_hash STRING, confidence DOUBLE,
processed_at STRING, status STRING, notes STRING, visual_frame_count BIGINT, multimodal_enabled BOOLEAN, author STRING,
upload_date STRING"""


def listing(spark: SparkSession, folder: str, recursive: bool = True, prefix: str = "") -> DataFrame:
    """``path, size, modified_at, content_type`` of all files below ``folder/prefix``, by path; their contents are not read."""
    folder = f"{folder.rstrip('/')}/{prefix}*" if prefix else folder
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), content_type("path").alias("content_type")).orderBy("path")


#: Bytes of a file that its id depends on.
PREFIX = 16_384


@F.arrow_udf(T.BinaryType())
def _beginnings(paths: pa.Array) -> pa.Array:
    """The first bytes of files, read on the executors; null for a file that cannot be read."""
    from urllib.parse import quote

    from pyarrow import fs

    out = []
    for path in paths.to_pylist():
        try:
            if path.startswith(("file:", "/")):
                system, inner = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
            else:
                system, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
            with system.open_input_file(inner) as f:
                out.append(f.read(PREFIX))
        except OSError:
            out.append(None)
    return pa.array(out, pa.binary())


def videos(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Source items of the video files of a folder, with ids that stay the same as long as the files do.

    Only the first ``PREFIX`` bytes of a file are read; ids are made of the absolute path, without its scheme.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    files = files.filter(suffix.isin(VIDEO_SUFFIXES)).withColumn("plain", F.regexp_replace("path", "^file:/+", "/")).withColumn("begin", F.coalesce(_beginnings("path"), F.lit(b"")))
    stem = F.regexp_extract("path", r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)
    parent = F.element_at(F.split("plain", "/"), -2)
    return files.select(F.lit("LOCAL_FILE").alias("source_type"), file_id("plain", "length", "begin").alias("source_id"), F.col("path").alias("uri"), stem.alias("title"), F.col("length").alias("file_size_bytes"), suffix.alias("container_format"), parent.alias("parent_collection"))


def link_list(spark: SparkSession, path: str) -> DataFrame:
    return listed_lines(spark.read.text(path))


def subtitles(spark: SparkSession, path: str) -> DataFrame:
    """``path, segments`` of SRT and VTT files, one row per file."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{srt,vtt}").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), parse_cues(F.replace("value", F.lit("\r\n"), F.lit("\n"))).alias("segments"))


def sibling_subtitles(videos_: DataFrame, files: DataFrame) -> DataFrame:
    """``video, subtitle``: of the files beside a video, the first of stem.srt, stem.vtt, stem.en.srt, stem.en.vtt."""
    v = videos_.select(F.col("uri").alias("video"), F.regexp_replace("uri", r"\.[^./\\]+$", "").alias("base"))
    kinds = [".srt", ".vtt", ".en.srt", ".en.vtt"]
    wanted = v.select("video", F.posexplode(F.array(*[F.concat("base", F.lit(k)) for k in kinds])).alias("rank", "path"))
    return ranked_pick(wanted.join(files.select("path"), "path"), "video", F.col("rank")).select("video", F.col("path").alias("subtitle"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest written as a JSON array or as lines; unknown keys are dropped, ``quality`` stands in for its newer name.

    Of several rows of one source the last counts.
    """
    first = spark.read.text(path).filter("trim(value) <> ''").first()
    whole = first is not None and first["value"].lstrip().startswith("[")
    rows = spark.read.schema(MANIFEST).json(path, multiLine=whole, mode="PERMISSIVE").withColumn("__at", F.monotonically_increasing_id())
    rows = ranked_pick(rows, "source_id", -F.col("__at")).drop("__at")
    return rows.withColumn("quality_status", F.coalesce("quality_status", "quality")).drop("quality")


def state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(processed, failed) of a state file that maps ids to details."""
    detail = "struct<status string, output_path string, error string, retry_count int, updated_at string>"
    rows = spark.read.schema(f"processed map<string, {detail}>, failed map<string, {detail}>").json(path, multiLine=True)
    return tuple(rows.select(F.explode(c).alias("source_id", "d")).select("source_id", "d.*") for c in ("processed", "failed"))
