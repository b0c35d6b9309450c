"""From sources and transcripts to results, a manifest and a summary: one lazy plan, failures as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.config import Config
from turnstone.functions import hashing as H
from turnstone.operators import captions as C
from turnstone.operators import dedup as D
from turnstone.operators import gates as G
from turnstone.operators import report as R
from turnstone.operators.queueing import ranked_pick
from turnstone.session import cut_lineage


@dataclass
class Run:
    results: DataFrame
    manifest: DataFrame
    counters: DataFrame
    breakdowns: DataFrame


def choose_transcript(transcripts: DataFrame) -> DataFrame:
    """Each source's transcript: manual captions, then automatic ones, files beside the video, speech recognition."""
    order = ["MANUAL_CAPTIONS", "AUTO_CAPTIONS", "EXTERNAL_FILE", "LOCAL_STT"]
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("transcript_source")), F.lit(0)), F.lit(99))
    return ranked_pick(transcripts.filter("source_id IS NOT NULL"), "source_id", rank, F.col("transcript_id"))


def planned(sources: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``source_id, title, transcript_source``: what a run would process, without reading a text (a dry run)."""
    chosen = choose_transcript(transcripts.select("source_id", "transcript_id", "transcript_source")).select("source_id", "transcript_source")
    return sources.filter("source_id IS NOT NULL").groupBy("source_id").agg(F.max("title").alias("title")).join(chosen, "source_id", "left")


def process(sources: DataFrame, transcripts: DataFrame, config: Config = Config(), done: DataFrame | None = None, frames: DataFrame | None = None) -> Run:
    """Gates, clean text, fingerprints and repeats of every source.

    Repeated sources and (with ``done``) sources handled before are SKIPPED; a source without a transcript fails with
    NO_TRANSCRIPT. Every source of the input has a result. With ``frames`` (``source_id, frame_id``) results hold how many
    frames their source has. The gated rows are written once (see ``cut_lineage``); the
    manifest and all reports read them.
    """
    order = F.struct(F.col("discovered_at").cast("timestamp"), "item_id")
    items = D.mark_repeats(sources.select("source_id", "source_type", "uri", "title", "item_id", order.alias("__order")).distinct(), "source_id", "__order", "item_id")
    if done is not None and config.resume and not config.force:
        items = items.join(done.select("source_id", F.lit(True).alias("__done")).distinct(), "source_id", "left")
    else:
        items = items.withColumn("__done", F.lit(None).cast("boolean"))
    chosen = choose_transcript(transcripts).select("source_id", "transcript_source", "language_code", "segments", "raw_text", F.lit(True).alias("__found"))
    rows = items.join(chosen, "source_id", "left")
    if frames is None:
        rows = rows.withColumn("__frames", F.lit(0).cast("long"))
    else:
        counts = frames.filter("source_id IS NOT NULL").groupBy("source_id").agg(F.count_distinct("frame_id").alias("__frames"))
        rows = rows.join(counts, "source_id", "left")
    text = C.normal_text("segments", "raw_text", config.words_per_paragraph)
    rows = rows.withColumn("text", text).withColumn("decision", G.language_decision("raw_text", "language_code", config.target_language))
    rows = rows.withColumn("quality", G.quality("text", F.size("segments"), G.mean_confidence("segments"), config.min_words, config.min_characters, config.max_repetition, config.max_abnormal))
    outcome = G.outcome(F.col("decision"), F.col("quality"), F.coalesce("__found", F.lit(False)))
    skipped = F.col("is_repeat") | F.coalesce("__done", F.lit(False))
    nothing = F.struct(F.lit("SKIPPED").alias("status"), F.lit(None).cast("string").alias("error_category"))
    rows = rows.withColumn("outcome", F.when(skipped, nothing).otherwise(outcome))
    ok = F.col("outcome.status") == "SUCCESS"
    results = cut_lineage(
        rows.select(
            "source_id", "source_type", "uri", "title", "item_id", "transcript_source", "outcome.status", "outcome.error_category",
            F.col("decision.detected_language").alias("language"), F.col("quality.status").alias("quality_status"),
            F.col("quality.word_count").cast("long").alias("word_count"), F.col("quality.character_count").cast("long").alias("character_count"),
            F.coalesce("__frames", F.lit(0).cast("long")).alias("visual_frame_count"), F.when(ok, F.col("text")).alias("text"),
            F.when(ok, H.sha256("raw_text")).alias("raw_hash"), F.when(ok, H.sha256("text")).alias("text_hash"), F.when(ok, H.normalized_hash("text")).alias("normalized_hash"),
        )
    )
    good = results.filter("status = 'SUCCESS'")
    owners = D.content_owner(good, "source_id", "text", "item_id").select("source_id", F.col("owner"), F.col("status").alias("dedup_status"))
    manifest = good.join(owners, "source_id").withColumn("output_path", F.concat("source_id", F.lit(".txt")))
    return Run(results, manifest, R.run_counters(results), R.breakdowns(results))
