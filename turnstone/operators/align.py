"""Joining frames, segments and chunks of a source by time.

Every join has the source and a time bucket as equality keys, so a source of any length is spread over many tasks.
Times are compared in whole milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone.functions.timing import millis
from turnstone.session import cut_lineage

BUCKET_MS = 600_000


def frame_interval(seconds: float) -> float:
    """A configured distance of frames, at least one second; ``frame_times`` takes any distance it is given."""
    return max(1.0, float(seconds))


def frame_times(duration_seconds: str | Column, interval: float) -> Column:
    """Array of sampling times of a video: 0, interval, 2 * interval ... below its duration."""
    d = F.col(duration_seconds) if isinstance(duration_seconds, str) else duration_seconds
    step = float(interval)
    if not step > 0:
        raise ValueError("interval must be above 0")
    n = F.ceil(d / step).cast("int")
    return F.when(d > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.round(i * step, 3))).otherwise(F.array().cast("array<double>"))


def audio_pieces(duration_seconds: str | Column, length: float = 600.0) -> Column:
    """Array of (offset, length) pieces that follow one another without overlap."""
    d = F.col(duration_seconds) if isinstance(duration_seconds, str) else duration_seconds
    n = F.ceil(d / length).cast("int")
    none = F.array().cast("array<struct<offset double, length double>>")
    return F.when(d > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * length).alias("offset"), F.least(F.lit(length), d - i * length).alias("length")))).otherwise(none)


def _spans(segments: DataFrame) -> DataFrame:
    rows = segments.select("source_id", F.col("seg_id"), millis("start").alias("a"), millis(F.col("start") + F.coalesce("duration", F.lit(0.0))).alias("z"))
    return rows.filter("source_id IS NOT NULL AND a IS NOT NULL").withColumn("z", F.greatest("a", "z"))


def _points(frames: DataFrame) -> DataFrame:
    return frames.select("source_id", "frame_id", millis("timestamp").alias("t")).filter("source_id IS NOT NULL AND t IS NOT NULL")


#: Buckets of one level that a span lies in at most, less one; longer spans lie in wider buckets.
_FAN = 64
_LEVELS = 7


def _leveled(rows: DataFrame, low: str, high: str, bucket_ms: int) -> DataFrame:
    """``rows`` with ``lv``: the least level whose buckets (``_FAN`` times as wide from level to level) suit the span."""
    lv = F.lit(_LEVELS - 1)
    for n in reversed(range(_LEVELS - 1)):
        lv = F.when(F.col(high) - F.col(low) <= bucket_ms * _FAN ** (n + 1), n).otherwise(lv)
    return rows.withColumn("lv", lv)


def _present(*rows: DataFrame) -> list[int]:
    """The levels that occur: one in all ordinary data, never more than ``_LEVELS``."""
    return sorted({r["lv"] for x in rows for r in x.select("lv").distinct().collect()})


def _bins(rows: DataFrame, levels: list[int], low: str, high: str, bucket_ms: int, own_only: bool = False) -> DataFrame:
    """A row for each bucket ``at, b`` of the levels from a row's own on; so no span, however long, becomes many rows."""
    width = F.element_at(F.array(*[F.lit(float(bucket_ms * _FAN**n)) for n in range(_LEVELS)]), F.col("at") + 1)
    rows = rows.withColumn("at", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    rows = rows.filter("at = lv" if own_only else "at >= lv")
    return rows.withColumn("b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))


def _meeting(points: DataFrame, spans: DataFrame, bucket_ms: int) -> DataFrame:
    """All pairs of a point ``t`` and a span ``a, z`` of the same source that holds it, both ends included."""
    spans = _leveled(spans, "a", "z", bucket_ms)
    levels = _present(spans)
    binned = _bins(points.withColumn("lv", F.lit(0)), levels, "t", "t", bucket_ms).drop("lv")
    return binned.join(_bins(spans, levels, "a", "z", bucket_ms, own_only=True), ["source_id", "at", "b"]).filter("t BETWEEN a AND z")


def frames_within(frames: DataFrame, segments: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``source_id, frame_id, seg_id``: all pairs of a frame and a segment that spans its time, both ends included."""
    return _meeting(_points(frames), cut_lineage(_spans(segments)), bucket_ms).select("source_id", "frame_id", "seg_id")


def align_frames(frames: DataFrame, segments: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``source_id, frame_id, seg_id, contained, distance_ms``: every frame's segment.

    The first segment that spans the frame wins (ends included); a frame in none goes to the segment with the nearest
    start or end, the first of those at the same distance. Segments are ordered by start, then ``seg_id``. A frame
    whose source has no segment has a null segment. Frame ids are unique per source.

    The segment before and after a frame come from two sweeps over each time bucket, forward and backward; what earlier
    and later buckets add is one row per bucket, swept per source in the same way.
    """
    points, spans = cut_lineage(_points(frames)), cut_lineage(_spans(segments))
    inside = _meeting(points, spans, bucket_ms).groupBy("source_id", "frame_id").agg(F.min(F.struct("a", "seg_id")).alias("hit"))

    # Before: the latest end, of these the first segment. After: the earliest start, of these the first segment.
    event = "struct<t:bigint,s:struct<a:bigint,seg_id:bigint>>"
    none = F.lit(None).cast(event)
    mark = F.struct("t", "s").cast(event)
    first = lambda c: spans.groupBy("source_id", F.col(c).alias("t")).agg(F.min(F.struct("a", "seg_id")).alias("s"))
    nameless = F.lit(None).cast("string").alias("frame_id")
    rows = (
        first("z").select("source_id", "t", mark.alias("ended"), none.alias("begun"), nameless)
        .unionByName(first("a").select("source_id", "t", none.alias("ended"), mark.alias("begun"), nameless))
        .unionByName(points.select("source_id", "t", none.alias("ended"), none.alias("begun"), "frame_id"))
        .withColumn("b", F.floor(F.col("t") / bucket_ms))
    )
    here = Window.partitionBy("source_id", "b")
    so_far = lambda c, order: F.last(c, ignorenulls=True).over(here.orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("before", so_far("ended", F.asc("t"))).withColumn("after", so_far("begun", F.desc("t")))
    # Written once: the frames' rows and what buckets hand on to one another both start here.
    rows = cut_lineage(rows)
    reach = rows.groupBy("source_id", "b").agg(F.max("ended").alias("e"), F.min("begun").alias("s"))
    passed = lambda c, order: F.last(c, ignorenulls=True).over(Window.partitionBy("source_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    reach = reach.select("source_id", "b", passed("e", F.asc("b")).alias("earlier"), passed("s", F.desc("b")).alias("later"))
    near = rows.filter("frame_id IS NOT NULL").join(reach, ["source_id", "b"], "left")
    near = near.select("source_id", "frame_id", "t", F.coalesce("before", "earlier").alias("x"), F.coalesce("after", "later").alias("y"))
    candidate = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["t"] - F.col("t")).alias("d"), F.col(c)["s"]["a"].alias("a"), F.col(c)["s"]["seg_id"].alias("seg_id")))
    near = near.withColumn("n", F.array_min(F.array_compact(F.array(candidate("x"), candidate("y")))))
    out = near.join(inside, ["source_id", "frame_id"], "left")
    hit = F.col("hit").isNotNull()
    return out.select("source_id", "frame_id", F.when(hit, F.col("hit.seg_id")).otherwise(F.col("n.seg_id")).alias("seg_id"), hit.alias("contained"), F.when(hit, F.lit(0)).otherwise(F.col("n.d")).alias("distance_ms"))


def frames_by_segment(frames: DataFrame, segments: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``source_id, seg_id, start, end, text, speaker, frames``: every segment with the frames that ``align_frames`` gives it.

    Frames (``timestamp, frame_id, file_path, visual_type, description, confidence``) are in order of time, then id;
    segments without one have an empty list. Frames of sources without segments are in no row.
    """
    columns = ["timestamp", "frame_id", "file_path", "visual_type", "description", "confidence"]
    of = align_frames(frames, segments, bucket_ms).filter("seg_id IS NOT NULL").select("source_id", "frame_id", "seg_id")
    full = frames.select("source_id", *columns).withColumn("f", F.struct(*columns)).select("source_id", "frame_id", "f")
    lists = of.join(full, ["source_id", "frame_id"]).groupBy("source_id", "seg_id").agg(F.array_sort(F.collect_list("f")).alias("frames"))
    end = F.col("start") + F.coalesce("duration", F.lit(0.0))
    rows = segments.filter("source_id IS NOT NULL AND start IS NOT NULL").select("source_id", "seg_id", "start", end.alias("end"), "text", "speaker")
    out = rows.join(lists, ["source_id", "seg_id"], "left")
    return out.withColumn("frames", F.coalesce("frames", F.array().cast(lists.schema["frames"].dataType)))


def chunk_frames(chunks: DataFrame, frames: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``chunk_id, n_frames, frames``: distinct frame files within a chunk's time, ends included, sorted.

    Chunks without a frame have an empty list; null and empty paths are no frames.
    """
    spans = cut_lineage(chunks.select("chunk_id", "source_id", millis("start_timestamp").alias("a"), millis("end_timestamp").alias("z")).distinct())
    points = frames.filter("file_path IS NOT NULL AND file_path <> ''").select("source_id", "file_path", millis("timestamp").alias("t")).filter("t IS NOT NULL")
    found = _meeting(points, spans.filter("a IS NOT NULL AND z >= a"), bucket_ms)
    found = found.groupBy("chunk_id").agg(F.array_sort(F.collect_set("file_path")).alias("frames"))
    return spans.select("chunk_id").distinct().join(found, "chunk_id", "left").select("chunk_id", F.coalesce(F.size("frames"), F.lit(0)).alias("n_frames"), F.coalesce("frames", F.array().cast("array<string>")).alias("frames"))


def assign_speakers(segments: DataFrame, diarization: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``seg_id, speaker, overlap_ms``: the speaker whose diarized intervals overlap a segment most (ties: by name).

    Intervals of one speaker add up. Segments that overlap none have a null speaker.
    """
    spans = cut_lineage(_leveled(_spans(segments), "a", "z", bucket_ms))
    talk = diarization.select("source_id", F.upper(F.trim("speaker")).alias("speaker"), millis("start").alias("da"), millis("end").alias("dz")).filter("source_id IS NOT NULL AND speaker IS NOT NULL AND dz > da")
    talk = cut_lineage(_leveled(talk, "da", "dz", bucket_ms))
    levels = _present(spans, talk)
    both = _bins(spans, levels, "a", "z", bucket_ms).join(_bins(talk, levels, "da", "dz", bucket_ms).withColumnRenamed("lv", "lv2"), ["source_id", "at", "b"])
    # A pair meets on the wider of its two levels; the part of the overlap inside each bucket adds up to the whole.
    both = both.filter("at = greatest(lv, lv2) AND da < z AND a < dz")
    width = F.element_at(F.array(*[F.lit(bucket_ms * _FAN**n) for n in range(_LEVELS)]), F.col("at") + 1)
    part = F.least("z", "dz", (F.col("b") + 1) * width) - F.greatest("a", "da", F.col("b") * width)
    votes = both.groupBy("source_id", "seg_id", "speaker").agg(F.sum(F.greatest(part, F.lit(0))).alias("ms")).filter("ms > 0")
    best = votes.groupBy("source_id", "seg_id").agg(F.min(F.struct((-F.col("ms")).alias("m"), "speaker")).alias("v"))
    return spans.select("source_id", "seg_id").join(best, ["source_id", "seg_id"], "left").select("seg_id", "v.speaker", F.coalesce(-F.col("v.m"), F.lit(0)).alias("overlap_ms"))
