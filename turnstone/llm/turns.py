"""Clean, ordered speaker turns from timed transcript segments.

Segments are read row by row (labels, clean words), then swept in order of time. The sweep is cut into time buckets of
a source, so that a round-the-clock source is shared among many tasks: each bucket gives its islands (stretches of one
speaker), and only the islands at a bucket's ends, a few rows each, are stitched in a second sweep over the source.
Inside an island, segments are joined to utterances: what a rolling caption repeats leaves the text, and a pause longer
than the source's calibrated one begins a new utterance.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from turnstone.llm.speech import read_segment, roster_of
from turnstone.session import cut_lineage

#: Sources with more than one in so many of all segments are split; so at most so many sources are.
SPLIT = 1000
BUCKET_SECONDS = 600.0
#: Share of a source's gaps between segments that are no pause, and the least seconds of a pause.
PAUSE_SHARE = 0.98
PAUSE_LEAST = 1.0
#: Fewest words of a suffix-prefix overlap that count as repeated.
OVERLAP_LEAST = 3


def _overlap(before: list[str], new: list[str]) -> int:
    """How many words at the end of ``before`` are the first of ``new``, at most; linear in the length of ``new``."""
    if not new:
        return 0
    border = [0] * len(new)  # prefix function of Knuth, Morris and Pratt
    k = 0
    for i in range(1, len(new)):
        while k and new[i] != new[k]:
            k = border[k - 1]
        k += new[i] == new[k]
        border[i] = k
    k = 0
    for word in before[-len(new) :]:
        while k and (k == len(new) or word != new[k]):
            k = border[k - 1]
        k += word == new[k]
    return k


def merge_rolling(texts: list[str], least: int = OVERLAP_LEAST) -> list[str]:
    """Each text without the words that repeat the end of what came before it.

    The longest overlap of at least ``least`` words counts, however long, compared without case.
    """
    if len(texts) == 1:
        return [" ".join((texts[0] or "").split())]
    out: list[str] = []
    low: list[str] = []
    for text in texts:
        new = (text or "").split()
        new_low = [w.lower() for w in new]
        # The last word so far ends any overlap, so it stands in the new text at its end.
        cut = _overlap(low, new_low) if low and low[-1] in new_low[least - 1 :] else 0
        if cut < least:
            cut = 0
        out.append(" ".join(new[cut:]))
        low += new_low[cut:]
    return out


#: start, end, first_seg_id, last_seg_id, n_segments, text
Utterance = tuple[float, float, int, int, int, str]


def merge_utterances(said: list[Utterance], pause: float | None, least: int = OVERLAP_LEAST) -> list[Utterance]:
    """Joins what one speaker said in a row to utterances; those after a pause of more than ``pause`` seconds stay apart.

    ``said`` is in order; its members and those of the result are utterances of their own, so results can be merged again.
    """
    out: list[Utterance] = []
    for (start, end, first, last, n, _), text in zip(said, merge_rolling([u[5] for u in said], least)):
        if out and (pause is None or start - out[-1][1] <= pause):
            was = out[-1]
            out[-1] = (was[0], max(was[1], end), was[2], last, was[4] + n - (was[3] == first), f"{was[5]} {text}" if was[5] and text else was[5] or text)
        else:
            out.append((start, end, first, last, n, text))
    return out


_FIELDS = (("start", T.DoubleType(), pa.float64()), ("end", T.DoubleType(), pa.float64()), ("first_seg_id", T.LongType(), pa.int64()), ("last_seg_id", T.LongType(), pa.int64()), ("n_segments", T.IntegerType(), pa.int32()), ("text", T.StringType(), pa.string()))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(k, t) for k, t, _ in _FIELDS])))
def _merged(said: pa.Array, pause: pa.Array) -> pa.Array:
    flat = said.flatten()
    rows = list(zip(*(flat.field(k).to_pylist() for k, _, _ in _FIELDS)))
    out, offsets, at = [], [0], 0
    for n, p in zip(said.value_lengths().fill_null(0).to_pylist(), pause.to_pylist()):
        out += merge_utterances(rows[at : at + n], p)
        at += n
        offsets.append(len(out))
    columns = zip(*out) if out else [()] * len(_FIELDS)
    struct = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(columns, _FIELDS)], names=[k for k, _, _ in _FIELDS])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)


_SAID = T.ArrayType(T.StructType([T.StructField("speaker_id", T.LongType()), T.StructField("said", T.StringType())]))


@F.arrow_udf(_SAID)
def _read(text: pa.Array, speaker: pa.Array, roster: pa.Array) -> pa.Array:
    """Column function of text, speaker and packed roster: the segment's stretches."""
    packed = roster.dictionary_encode()
    rosters = [roster_of(r or "") for r in packed.dictionary.to_pylist()]
    nobody = roster_of("")
    offsets, ids, said = [0], [], []
    for t, s, r in zip(text.to_pylist(), speaker.to_pylist(), packed.indices.to_pylist()):
        for i, words in read_segment(t, s, nobody if r is None else rosters[r]):
            ids.append(i)
            said.append(words)
        offsets.append(len(ids))
    rows = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(said, pa.string())], names=["speaker_id", "said"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def packed_roster(roster: DataFrame) -> DataFrame:
    """One row per source with its speakers as one string."""
    fields = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), "[\x1e\x1f]", " "), F.lit("")) for c in ("speaker_id", "full_name", "speaker_role", "diar_label")]
    rows = roster.filter("source_id IS NOT NULL AND speaker_id IS NOT NULL").select(F.col("source_id").alias("r_source"), F.concat_ws("\x1f", *fields).alias("x"))
    return rows.groupBy("r_source").agg(F.array_join(F.array_sort(F.collect_set("x")), "\x1e").alias("roster"))


def hot_sources(rows: DataFrame, source: str = "source_id", split: int = SPLIT) -> dict[str, int]:
    """Sources with more than one in ``split`` of all rows (so at most ``split`` of them), and into how many parts to cut each."""
    counts = rows.groupBy(F.col(source).alias("s")).agg(F.count("*").alias("n")).filter("s IS NOT NULL")
    total = counts.agg(F.sum("n").alias("total"))  # one row
    hot = counts.crossJoin(F.broadcast(total)).filter(F.col("n") * split > F.col("total")).collect()
    return {r["s"]: -(-4 * split * r["n"] // r["total"]) for r in hot}


def _parts_of(source: str, hot: dict[str, int]) -> Column:
    """Into how many parts a source's rows are cut."""
    if not hot:
        return F.lit(1)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in sorted(hot.items()) for x in pair]), F.col(source)), F.lit(1))


def calibrated_pauses(segments: DataFrame, share: float = PAUSE_SHARE, least: float = PAUSE_LEAST) -> DataFrame:
    """``p_source, pause``: the gap between segments that only ``1 - share`` of the source's gaps exceed.

    The gap after a segment is bounded by its time bucket, so no source is swept in one task; quantiles come from
    mergeable sketches over all gaps.
    """
    rows = segments.filter("start IS NOT NULL AND NOT isnan(start) AND source_id IS NOT NULL")
    rows = rows.select("source_id", F.col("start").cast("double").alias("start"), _end().alias("end"), F.floor(F.col("start") / BUCKET_SECONDS).alias("b"))
    gap = F.lead("start").over(Window.partitionBy("source_id", "b").orderBy("start", "end")) - F.col("end")
    gaps = rows.select("source_id", gap.alias("gap")).filter("gap >= 0")
    return gaps.groupBy(F.col("source_id").alias("p_source")).agg(F.greatest(F.percentile_approx("gap", F.lit(share), F.lit(1000)), F.lit(least)).alias("pause"))


def _end() -> Column:
    return F.col("start").cast("double") + F.greatest(F.coalesce(F.nanvl(F.col("duration").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def spoken_stretches(segments: DataFrame, roster: DataFrame, pauses: DataFrame | None = None, hot: dict[str, int] | None = None) -> DataFrame:
    """``source_id, seg_id, start, end, pause, pos, speaker_id, said``: stretches of spoken words, speaker null for 'goes on'.

    Rows without source, start (NaN included) or text, and segments without spoken words, are left out. Segments of a
    hot source (see ``hot_sources``) meet as many copies of its roster as it has parts.
    """
    hot = hot_sources(segments) if hot is None else hot
    rows = segments.select("source_id", "seg_id", "text", F.col("start").cast("double").alias("start"), _end().alias("end"), F.col("speaker").cast("string").alias("speaker"))
    rows = rows.filter(F.col("source_id").isNotNull() & F.col("start").isNotNull() & ~F.isnan("start") & F.col("text").isNotNull())
    about = packed_roster(roster)
    if pauses is not None:
        about = about.hint("merge").join(pauses, F.col("r_source") == F.col("p_source"), "full").select(F.coalesce("r_source", "p_source").alias("r_source"), "roster", "pause")
    else:
        about = about.withColumn("pause", F.lit(None).cast("double"))
    about = about.withColumn("r_part", F.explode(F.sequence(F.lit(0), _parts_of("r_source", hot) - 1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("seg_id", "start"), _parts_of("source_id", hot)).cast("int"))
    rows = rows.join(about, (F.col("source_id") == F.col("r_source")) & (F.col("part") == F.col("r_part")), "left")
    # Not taken for deterministic, so that the planner does not evaluate it again for filters on its result.
    rows = rows.withColumn("stretch", _read.asNondeterministic()("text", "speaker", "roster"))
    rows = rows.select("source_id", "seg_id", "start", "end", "pause", F.posexplode("stretch").alias("pos", "s"))
    return rows.select("source_id", "seg_id", "start", "end", "pause", "pos", "s.speaker_id", "s.said")


def speaker_turns(segments: DataFrame, roster: DataFrame, pause_share: float | None = PAUSE_SHARE, bucket_seconds: float = BUCKET_SECONDS, hot: dict[str, int] | None = None) -> DataFrame:
    """``source_id, speaker_id, first_seg_id, last_seg_id, start, end, n_segments, utterances`` per turn.

    ``segments`` holds current rows (``source_id, seg_id, text, start, duration, speaker``), ``roster`` rows of
    ``source_id, speaker_id, full_name, speaker_role, diar_label``. A turn is the longest stretch of one speaker's
    spoken words in order of ``start`` (ties: ``seg_id``). Its ``utterances`` (``start, end, first_seg_id, last_seg_id,
    n_segments, text``) are its clean text without what rolling captions repeat, split at pauses longer than the
    source's calibrated one (see ``calibrated_pauses``; with ``pause_share`` None at none). Words before any label have
    a null speaker. Null or empty texts, null starts and segments without spoken words belong to no turn. A label that
    names no speaker of the source's roster, or several, is no label. Empty tables give an empty result; columns not
    named are ignored. ``hot``: what ``hot_sources`` gives, if it is known from a cheaper reading of the same rows.
    """
    pauses = None if pause_share is None else calibrated_pauses(segments, pause_share)
    pieces = spoken_stretches(segments, roster, pauses, hot).withColumn("b", F.floor(F.col("start") / F.lit(float(bucket_seconds))))

    in_bucket = Window.partitionBy("source_id", "b").orderBy("start", "seg_id", "pos")
    who = F.last("speaker_id", ignorenulls=True)
    pieces = pieces.withColumn("spk", who.over(in_bucket.rowsBetween(Window.unboundedPreceding, 0))).withColumn("prev_spk", who.over(in_bucket.rowsBetween(Window.unboundedPreceding, -1)))
    pieces = pieces.withColumn("isle", F.sum((~F.col("spk").eqNullSafe(F.col("prev_spk"))).cast("int")).over(in_bucket))
    at = F.struct("start", "seg_id", "pos")
    one = F.struct("start", "end", F.col("seg_id").alias("first_seg_id"), F.col("seg_id").alias("last_seg_id"), F.lit(1).alias("n_segments"), F.col("said").alias("text"))
    in_order = lambda c: F.transform(F.array_sort(c), lambda x: x["u"])
    isles = pieces.groupBy("source_id", "b", "isle").agg(
        F.first("spk").alias("spk"), F.min_by("prev_spk", at).alias("prev_spk"), F.min(at).alias("first"), F.max(at).alias("last"), F.max("pause").alias("pause"), F.collect_list(F.struct(at.alias("at"), one.alias("u"))).alias("said")
    )
    isles = isles.select("source_id", "b", "isle", "spk", "prev_spk", "first", "last", "pause", _merged(in_order("said"), "pause").alias("utterances"))

    # Islands that can touch another bucket: the unlabelled ones at its front, the first labelled, and the last.
    bucket = Window.partitionBy("source_id", "b")
    isles = isles.withColumn("edge", F.col("prev_spk").isNull() | (F.col("isle") == F.max("isle").over(bucket)))
    # Written once: the finished islands and those at the edges take different ways from here.
    isles = cut_lineage(isles)
    per_source = Window.partitionBy("source_id").orderBy("b", "isle")
    earlier = per_source.rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        isles.filter("edge")
        .withColumn("carry", F.last("spk", ignorenulls=True).over(earlier))
        .withColumn("nth", F.row_number().over(per_source))
        .withColumn("opens", (F.col("nth") == 1) | F.col("prev_spk").isNotNull() | (F.col("spk").isNotNull() & ~F.col("spk").eqNullSafe(F.col("carry"))))
        .withColumn("group", F.sum(F.col("opens").cast("int")).over(per_source))
    )
    shared = edges.groupBy("source_id", "group").agg(F.max("spk").alias("spk"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("pause").alias("pause"), F.collect_list(F.struct("b", "isle", F.col("utterances").alias("u"))).alias("parts"))
    shared = shared.select("source_id", "spk", "first", "last", _merged(F.flatten(in_order("parts")), "pause").alias("utterances"))
    inner = isles.filter("NOT edge").select("source_id", "spk", "first", "last", "utterances")
    total = F.aggregate("utterances", F.lit(0), lambda acc, u: acc + u["n_segments"])
    turns = inner.unionByName(shared)
    return turns.select("source_id", F.col("spk").alias("speaker_id"), F.col("first.seg_id").alias("first_seg_id"), F.col("last.seg_id").alias("last_seg_id"), F.col("first.start").alias("start"), F.element_at("utterances", -1)["end"].alias("end"), total.alias("n_segments"), "utterances")


def utterances(turns: DataFrame) -> DataFrame:
    """One row per utterance: turns split at speaker changes and calibrated pauses."""
    return turns.select("source_id", "speaker_id", F.explode("utterances").alias("u")).select("source_id", "speaker_id", "u.*")
