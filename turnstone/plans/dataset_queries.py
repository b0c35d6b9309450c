"""Registered queries on frames, chunks, manifests, runs, queues and discovery, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import text as X
from turnstone.functions import timing as TM
from turnstone.functions.hashing import sha256
from turnstone.operators import align as A
from turnstone.operators import catalog as K
from turnstone.operators import discovery as V
from turnstone.operators import queueing as Q
from turnstone.operators import report as R
from turnstone.plans.transcript_queries import _QUALITY, _assessed, _gate_en
from turnstone.operators import gates as G
from turnstone.session import current_rows, table


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "visual_frame").select("frame_id", "source_id", "timestamp", "file_path", "ingested_at")
    return current_rows(rows, "frame_id")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(table(spark, sf_dir, "transcript_segment").select("seg_id", "source_id", "start", "duration", "ingested_at"), "seg_id")


def frame_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.align_frames(_frames(spark, sf_dir), _segments(spark, sf_dir))


def frames_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.frames_within(_frames(spark, sf_dir), _segments(spark, sf_dir))


def chunk_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.chunk_frames(table(spark, sf_dir, "retrieval_chunk"), _frames(spark, sf_dir))
    return out.select("chunk_id", "n_frames", F.array_join("frames", ",").alias("frames"))


def speaker_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = current_rows(table(spark, sf_dir, "diarization_segment").select("diar_id", "source_id", "speaker", "start", "end", "ingested_at"), "diar_id")
    return A.assign_speakers(_segments(spark, sf_dir), talk)


def frame_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "source_item").filter("duration_seconds IS NOT NULL AND NOT isnan(duration_seconds)").select("item_id", "source_id", "duration_seconds").distinct()
    rows = items.select("item_id", "source_id", F.posexplode(A.frame_times("duration_seconds", 30.0)).alias("i", "t"))
    return rows.select("item_id", F.format_string("%s_f%04d", "source_id", F.col("i") + 1).alias("frame_id"), F.col("t").alias("at"))


def audio_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "source_item").filter("duration_seconds IS NOT NULL AND NOT isnan(duration_seconds)").select("item_id", "duration_seconds").distinct()
    rows = items.select("item_id", F.explode(A.audio_pieces("duration_seconds")).alias("p"))
    return rows.select("item_id", TM.millis("p.offset").alias("offset_ms"), TM.millis("p.length").alias("length_ms"))


def display_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "diarization_segment").filter("start IS NOT NULL AND NOT isnan(start) AND start >= 0")
    return rows.select("diar_id", TM.clock("start").alias("srt"), TM.clock("start", ".").alias("vtt"), TM.clock_short("start").alias("shown"), F.round(TM.seconds_of(TM.clock_short("start")), 3).alias("seconds"))


def media_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "source_item")
    d = F.when(~F.isnan("duration_seconds"), F.col("duration_seconds"))
    problem = G.media_problem(d, "file_size_bytes", most_seconds=900.0, most_bytes=400 << 20)
    return rows.select("item_id", F.split_part(F.coalesce(problem, F.lit("none")), F.lit(" "), F.lit(1)).alias("problem"))


def _manifest(spark: SparkSession, sf_dir: str, newest: bool) -> DataFrame:
    rows = table(spark, sf_dir, "raw_transcript").filter("source_id IS NOT NULL")
    micros = F.unix_micros(F.col("retrieved_at").cast("timestamp"))
    rank = F.struct(-micros if newest else micros, -F.col("transcript_id") if newest else F.col("transcript_id"))
    rows = Q.ranked_pick(rows.select("source_id", "transcript_id", "raw_text", "retrieved_at"), "source_id", rank)
    return rows.select(
        "source_id",
        F.concat("source_id", F.lit(".txt")).alias("output_path"),
        sha256("raw_text").alias("text_hash"),
        X.word_count("raw_text").cast("long").alias("word_count"),
        F.coalesce(F.length("raw_text"), F.lit(0)).cast("long").alias("character_count"),
        F.coalesce("raw_text", F.lit("")).alias("content"),
    )


def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "raw_transcript").select("source_id", "transcript_id", "language_code", "retrieved_at").filter("source_id IS NOT NULL")
    rows = rows.withColumn("at", F.struct("retrieved_at", "transcript_id"))
    even = F.col("transcript_id") % 2 == 0  # every second one as the manifest that is there, the others as new rows
    kept = K.upsert(rows.filter(even), rows.filter(~even), "source_id", "at")
    return kept.select("source_id", "transcript_id", "language_code")


def version_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.version_totals(_manifest(spark, sf_dir, True))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources' first transcripts as manifest, last ones as files."""
    first = _manifest(spark, sf_dir, False).select("source_id", "text_hash")
    sources = table(spark, sf_dir, "source_item").select("source_id").distinct().join(first, "source_id", "left")
    manifest = sources.select(F.concat("source_id", F.lit(".txt")).alias("output_path"), "text_hash")
    last = _manifest(spark, sf_dir, True)
    return K.audit(manifest, last.select(F.col("output_path").alias("path"), F.length("content").alias("size"), "text_hash"))


def dataset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir)


def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.health(_audited(spark, sf_dir))


def manifest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = _manifest(spark, sf_dir, False).drop("content")
    files = _manifest(spark, sf_dir, True).select(F.col("output_path").alias("path"), "content")
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return K.repair(manifest, files.unionByName(docs))


def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results: errors are failures, purchases successes."""
    e = table(spark, sf_dir, "events").filter("event_type IN ('error', 'purchase')")
    return K.failures(e.select("user_id", "event_id", F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status")), "user_id", "event_id", "status")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The frames that a sampler takes of each source, one every 30 seconds.
    seconds = table(spark, sf_dir, "source_item").filter("source_id IS NOT NULL AND NOT isnan(duration_seconds)").groupBy("source_id").agg(F.max("duration_seconds").alias("seconds"))
    frames = seconds.select("source_id", F.size(A.frame_times("seconds", 30.0)).alias("n_frames"))
    rows = _assessed(spark, sf_dir).join(frames, "source_id", "left").withColumn("d", G.language_decision("raw_text", "language_code", "en"))
    rows = rows.withColumn("o", G.outcome(F.col("d"), F.col("q"), F.col("raw_text").isNotNull()))
    return rows.select(
        F.col("transcript_source").alias("source_type"),
        "o.status",
        "o.error_category",
        F.col("d.detected_language").alias("language"),
        F.col("q.status").alias("quality_status"),
        F.col("q.word_count").alias("word_count"),
        F.col("q.character_count").alias("character_count"),
        F.coalesce("n_frames", F.lit(0)).alias("visual_frame_count"),
    )


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_counters(_results(spark, sf_dir))


def run_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.breakdowns(_results(spark, sf_dir))


def word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "raw_transcript").filter("raw_text IS NOT NULL").select(X.word_count("raw_text").alias("n"))
    return R.word_stats(rows, "n")


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.group_counts(table(spark, sf_dir, "documents"), "collection")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("DONE")
    priority = 6 - F.left("o_orderpriority", F.lit(1)).cast("int")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), state.alias("state"), priority.alias("priority"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("org_id"))


def job_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.claim(_jobs(spark, sf_dir), workers=25)


def job_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.page(_jobs(spark, sf_dir), "created_at", "job_id", limit=20, offset=40, state="QUEUED")


def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).filter("state = 'QUEUED'").groupBy("org_id").agg(F.count("*").alias("depth"))


def lease_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as heartbeats of attempts, customers as their jobs."""
    beats = Q.last_heartbeats(table(spark, sf_dir, "events"), "user_id", "ts")
    attempts = beats.select(F.col("user_id").alias("attempt_id"), F.col("user_id").alias("job_id"), "heartbeat_at", F.lit(None).cast("timestamp_ntz").alias("completed_at"))
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.when(F.col("c_acctbal") > 0, "ACCEPTED").otherwise("COMPLETED").alias("state"), (F.col("c_nationkey") % 4).alias("attempt_count"), F.lit(3).alias("max_attempts"))
    out = Q.recover(attempts, jobs, F.to_timestamp(F.lit("2024-01-31 00:00:00")), 36_000, ["ACCEPTED"])
    return out.select("attempt_id", "job_id", F.floor("age_seconds").alias("age_seconds"), "next_state", "next_attempt")


def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "RATE_LIMITED").when(F.col("l_returnflag") == "A", "network_error").otherwise("NO_TRANSCRIPT").alias("category"))
    return Q.retries(rows, "category", "l_linenumber", most=6).groupBy("category", "l_linenumber", "retry", "delay_seconds").agg(F.count("*").alias("n"))


def metrics_last100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.recent_metrics(table(spark, sf_dir, "events"), "event_type", "ts", "event_id", "value")


def usage_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.usage(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus")


def track_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's caption track: manual before generated, then the smallest id."""
    rows = table(spark, sf_dir, "raw_transcript").filter("source_id IS NOT NULL").select("source_id", "transcript_id", "is_generated")
    return Q.ranked_pick(rows, "source_id", F.coalesce("is_generated", F.lit(True)), F.col("transcript_id"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "source_item").select("item_id", "uri", F.concat(F.lit("https://www.youtube.com/watch?list=PL"), F.col("item_id").cast("string"), F.lit("&v="), F.left("source_id", F.lit(11))).alias("link"))
    return V.routed(items, "link").select("item_id", "route", "video_id", "playlist_id", F.coalesce("link_problem", F.lit("none")).alias("link_problem"))


def uri_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.routed(table(spark, sf_dir, "source_item").select("item_id", "uri"), "uri")
    return rows.select("item_id", "route", F.coalesce("link_problem", F.lit("none")).alias("link_problem"))


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_item").select("item_id", V.display_name("title", "file_path", "source_id").alias("name"))


_NAMES = [
    "frame_alignment", "frames_within", "chunk_frames", "speaker_assignment", "frame_timeline", "audio_plan", "display_times", "media_limits", "manifest_upsert", "version_totals", "dataset_audit",
    "health_score", "manifest_repair", "failure_counts", "run_summary", "run_breakdowns", "word_stats", "source_counts", "job_claims", "job_page", "queue_depth", "lease_recovery", "retry_delays",
    "metrics_last100", "usage_by_month", "track_choice", "routes", "uri_routes", "display_names",
]
QUERIES = {name: globals()[name] for name in _NAMES}

_CUR = """
f AS (SELECT frame_id, source_id, file_path, CAST(round("timestamp" * 1000) AS BIGINT) AS t FROM visual_frame
      QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY ingested_at DESC NULLS LAST) = 1),
s AS (SELECT seg_id, source_id, CAST(round("start" * 1000) AS BIGINT) AS a, CAST(round(("start" + coalesce(duration, 0)) * 1000) AS BIGINT) AS z FROM transcript_segment
      QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY ingested_at DESC NULLS LAST) = 1),
fs AS (SELECT * FROM f WHERE source_id IS NOT NULL AND t IS NOT NULL),
ss AS (SELECT seg_id, source_id, a, greatest(a, z) AS z FROM s WHERE source_id IS NOT NULL AND a IS NOT NULL)
"""
_CLOCK = "printf('%02d:%02d:%02d{m}%03d', CAST(floor({s} / 3600) AS INT), CAST(floor((floor({s}) % 3600) / 60) AS INT), CAST(floor({s}) % 60 AS INT), CAST(round_even(({s} - floor({s})) * 1000, 0) AS INT))"
_SHORT = "printf('%02d:%02d:%02d', CAST(floor({s} / 3600) AS INT), CAST(floor((floor({s}) % 3600) / 60) AS INT), CAST(floor({s}) % 60 AS INT))"
_W = r"'[^\s\x0b\x1c-\x1f\x85\p{Z}]+'"


def _pick(direction: str) -> str:
    return f"""SELECT source_id, source_id || '.txt' AS output_path, sha256(raw_text) AS text_hash, CAST(coalesce(len(regexp_extract_all(raw_text, {_W})), 0) AS BIGINT) AS word_count,
      CAST(coalesce(length(raw_text), 0) AS BIGINT) AS character_count, coalesce(raw_text, '') AS content FROM raw_transcript WHERE source_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY retrieved_at {direction}, transcript_id {direction}) = 1"""


_AUDIT = f"""WITH l AS ({_pick('DESC')}), e AS ({_pick('ASC')}),
m AS (SELECT DISTINCT i.source_id || '.txt' AS path, e.text_hash FROM source_item i LEFT JOIN e ON i.source_id = e.source_id),
x AS (SELECT coalesce(m.path, l.output_path) AS path, CASE WHEN l.source_id IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'unindexed' WHEN length(l.content) = 0 THEN 'empty'
      WHEN m.text_hash IS NOT NULL AND m.text_hash IS DISTINCT FROM l.text_hash THEN 'modified' ELSE 'ok' END AS finding FROM m FULL JOIN l ON m.path = l.output_path)
"""
_RESULTS = _QUALITY + ", " + _gate_en("z") + """, r AS (SELECT transcript_source AS source_type,
  CASE WHEN raw_text IS NULL THEN 'NO_TRANSCRIPT' WHEN NOT (passed AND detected_language = 'en') THEN 'LANGUAGE_MISMATCH' WHEN status NOT IN ('GOOD', 'SUSPICIOUS') THEN 'QUALITY_FAILURE' END AS cat,
  detected_language AS language, status AS quality_status, n AS word_count, CASE WHEN n = 0 THEN 0 ELSE chars END AS character_count, coalesce((SELECT CAST(ceil(max(duration_seconds) / 30) AS INT) FROM source_item i WHERE i.source_id = d.source_id AND isfinite(duration_seconds)), 0) AS frames FROM d)
"""

ORACLE = {
    "frame_alignment": "WITH " + _CUR + """SELECT fs.source_id, frame_id, seg_id, coalesce(fs.t BETWEEN a AND z, false) AS contained,
        CASE WHEN fs.t BETWEEN a AND z THEN 0 ELSE least(abs(fs.t - a), abs(fs.t - z)) END AS distance_ms
        FROM fs LEFT JOIN ss ON fs.source_id = ss.source_id
        QUALIFY row_number() OVER (PARTITION BY fs.source_id, frame_id ORDER BY fs.t BETWEEN a AND z DESC, CASE WHEN fs.t BETWEEN a AND z THEN 0 ELSE least(abs(fs.t - a), abs(fs.t - z)) END, a, seg_id) = 1""",
    "frames_within": "WITH " + _CUR + "SELECT fs.source_id, frame_id, seg_id FROM fs JOIN ss ON fs.source_id = ss.source_id AND fs.t BETWEEN a AND z",
    "chunk_frames": "WITH " + _CUR + """, c AS (SELECT DISTINCT chunk_id, source_id, CAST(round(start_timestamp * 1000) AS BIGINT) AS a, CAST(round(end_timestamp * 1000) AS BIGINT) AS z FROM retrieval_chunk)
        SELECT chunk_id, CAST(count(DISTINCT file_path) AS INT) AS n_frames, coalesce(string_agg(DISTINCT file_path, ',' ORDER BY file_path), '') AS frames
        FROM c LEFT JOIN f ON c.source_id = f.source_id AND f.t BETWEEN a AND z AND file_path <> '' GROUP BY 1""",
    "speaker_assignment": "WITH " + _CUR + """, g AS (SELECT source_id, upper(trim(speaker, ' ')) AS speaker, CAST(round("start" * 1000) AS BIGINT) AS da, CAST(round("end" * 1000) AS BIGINT) AS dz
          FROM (SELECT * FROM diarization_segment QUALIFY row_number() OVER (PARTITION BY diar_id ORDER BY ingested_at DESC NULLS LAST) = 1)),
        v AS (SELECT seg_id, speaker, CAST(sum(greatest(least(z, dz) - greatest(a, da), 0)) AS BIGINT) AS ms FROM ss JOIN g ON ss.source_id = g.source_id AND da < z AND a < dz AND dz > da AND speaker IS NOT NULL GROUP BY 1, 2 HAVING ms > 0)
        SELECT ss.seg_id, speaker, coalesce(ms, 0) AS overlap_ms FROM ss LEFT JOIN v ON ss.seg_id = v.seg_id QUALIFY row_number() OVER (PARTITION BY ss.seg_id ORDER BY ms DESC NULLS LAST, speaker) = 1""",
    "frame_timeline": """SELECT item_id, source_id || '_f' || printf('%04d', CAST(i + 1 AS INT)) AS frame_id, CAST(i * 30 AS DOUBLE) AS at
        FROM (SELECT item_id, source_id, unnest(range(CAST(ceil(duration_seconds / 30) AS BIGINT))) AS i FROM (SELECT DISTINCT item_id, source_id, duration_seconds FROM source_item WHERE isfinite(duration_seconds)))""",
    "audio_plan": """SELECT item_id, i * 600000 AS offset_ms, CAST(round(least(600, duration_seconds - i * 600) * 1000) AS BIGINT) AS length_ms
        FROM (SELECT item_id, duration_seconds, unnest(range(CAST(ceil(duration_seconds / 600) AS BIGINT))) AS i FROM (SELECT DISTINCT item_id, duration_seconds FROM source_item WHERE isfinite(duration_seconds)))""",
    "display_times": f"""SELECT diar_id, {_CLOCK.format(s='"start"', m=',')} AS srt, {_CLOCK.format(s='"start"', m='.')} AS vtt, {_SHORT.format(s='"start"')} AS shown, CAST(floor("start") AS DOUBLE) AS seconds
        FROM diarization_segment WHERE isfinite("start") AND "start" >= 0""",
    "media_limits": "SELECT item_id, CASE WHEN isfinite(duration_seconds) AND duration_seconds > 900 THEN 'duration' WHEN file_size_bytes > 419430400 THEN 'size' ELSE 'none' END AS problem FROM source_item",
    "manifest_upsert": "SELECT source_id, transcript_id, language_code FROM raw_transcript WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY retrieved_at DESC, transcript_id DESC) = 1",
    "version_totals": f"SELECT count(*) AS total_sources, CAST(sum(word_count) AS BIGINT) AS total_words FROM ({_pick('DESC')})",
    "dataset_audit": _AUDIT + "SELECT path, finding FROM x",
    "health_score": _AUDIT + """, h AS (SELECT count(*) FILTER (WHERE finding IN ('ok', 'modified')) AS valid, count(*) FILTER (WHERE finding = 'missing') AS missing, count(*) FILTER (WHERE finding = 'empty') AS empty,
        count(*) FILTER (WHERE finding = 'modified') AS modified, count(*) FILTER (WHERE finding = 'unindexed') AS unindexed, count(*) FILTER (WHERE finding <> 'unindexed') AS records FROM x)
        SELECT valid, missing, empty, modified, unindexed, CAST(0 AS BIGINT) AS frames_missing, CAST(0 AS BIGINT) AS frames_empty, records,
        CAST(greatest(0, 100 - floor((20 * missing + 20 * empty + 15 * modified) * 100 / greatest(records, 1))) AS INT) AS score, missing + empty + modified = 0 AS is_healthy FROM h""",
    "manifest_repair": f"""WITH m AS ({_pick('ASC')}), f AS (SELECT output_path AS path, content FROM ({_pick('DESC')}) UNION ALL SELECT 'doc_' || doc_id || '.txt', text FROM documents WHERE text IS NOT NULL),
        h AS (SELECT path, sha256(content) AS fh, CAST(len(regexp_extract_all(content, {_W})) AS BIGINT) AS fw, CAST(length(content) AS BIGINT) AS fc FROM f),
        j AS (SELECT *, source_id IS NULL OR (fh IS NOT NULL AND text_hash IS DISTINCT FROM fh) AS fresh FROM m FULL JOIN h ON m.output_path = h.path)
        SELECT coalesce(source_id, regexp_replace(path, '\\.[^.]*$', '')) AS source_id, coalesce(output_path, path) AS output_path, CASE WHEN fresh THEN fh ELSE text_hash END AS text_hash,
        CASE WHEN fresh THEN fw ELSE word_count END AS word_count, CASE WHEN fresh THEN fc ELSE character_count END AS character_count,
        CASE WHEN source_id IS NULL THEN 'indexed' WHEN fresh THEN 'refreshed' ELSE 'kept' END AS action FROM j""",
    "failure_counts": """WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad FROM events WHERE event_type IN ('error', 'purchase')),
        w AS (SELECT *, max(CASE WHEN NOT bad THEN event_id END) OVER (PARTITION BY user_id) AS won FROM e)
        SELECT user_id, CASE WHEN arg_max(bad, event_id) THEN 'FAILED' ELSE 'SUCCESS' END AS status, count(*) FILTER (WHERE bad AND (won IS NULL OR event_id > won)) AS retry_count FROM w GROUP BY 1""",
    "run_summary": _RESULTS + """SELECT count(*) AS discovered, count(*) FILTER (WHERE cat IS NULL) AS processed, CAST(0 AS BIGINT) AS skipped, count(*) FILTER (WHERE cat = 'LANGUAGE_MISMATCH') AS language_mismatches,
        count(*) FILTER (WHERE cat = 'QUALITY_FAILURE') AS quality_failures, count(*) FILTER (WHERE cat = 'NO_TRANSCRIPT') AS failed, CAST(coalesce(sum(word_count) FILTER (WHERE cat IS NULL), 0) AS BIGINT) AS total_words,
        CAST(coalesce(sum(character_count) FILTER (WHERE cat IS NULL), 0) AS BIGINT) AS total_characters, CAST(coalesce(sum(frames) FILTER (WHERE cat IS NULL), 0) AS BIGINT) AS total_visual_frames FROM r""",
    "run_breakdowns": _RESULTS + """SELECT 'source_type' AS dimension, source_type AS value, count(*) AS n FROM r WHERE source_type IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'language', language, count(*) FROM r WHERE cat IS NULL GROUP BY 2 UNION ALL SELECT 'quality_status', quality_status, count(*) FROM r WHERE cat IS NULL GROUP BY 2""",
    "word_stats": f"""SELECT CAST(min(n) AS BIGINT) AS min, CAST(max(n) AS BIGINT) AS max, round(avg(n), 1) AS mean, round(quantile_cont(n, 0.5), 1) AS p50, round(quantile_cont(n, 0.9), 1) AS p90
        FROM (SELECT len(regexp_extract_all(raw_text, {_W})) AS n FROM raw_transcript WHERE raw_text IS NOT NULL)""",
    "source_counts": """SELECT value, n, CAST(round(n * 100 / max(n) OVER (), 1) AS DOUBLE) AS percent FROM (SELECT coalesce(nullif(collection, ''), 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1)""",
    "job_claims": """SELECT o_orderkey AS job_id, 'QUEUED' AS state, 6 - CAST(left(o_orderpriority, 1) AS INT) AS priority, o_orderdate AS created_at, o_custkey AS org_id FROM orders WHERE o_orderstatus = 'O'
        ORDER BY priority DESC, created_at, job_id LIMIT 25""",
    "job_page": """SELECT o_orderkey AS job_id, 'QUEUED' AS state, 6 - CAST(left(o_orderpriority, 1) AS INT) AS priority, o_orderdate AS created_at, o_custkey AS org_id FROM orders WHERE o_orderstatus = 'O'
        ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 40""",
    "queue_depth": "SELECT o_custkey AS org_id, count(*) AS depth FROM orders WHERE o_orderstatus = 'O' GROUP BY 1",
    "lease_recovery": """WITH b AS (SELECT user_id, max(ts) AS h FROM events GROUP BY 1)
        SELECT user_id AS attempt_id, user_id AS job_id, CAST(floor(epoch_us(TIMESTAMP '2024-01-31' - h) / 1e6) AS BIGINT) AS age_seconds, CASE WHEN c_nationkey % 4 < 3 THEN 'QUEUED' ELSE 'FAILED' END AS next_state,
        CASE WHEN c_nationkey % 4 < 3 THEN c_nationkey % 4 + 1 END AS next_attempt FROM b JOIN customer ON user_id = c_custkey WHERE c_acctbal > 0 AND epoch_us(TIMESTAMP '2024-01-31' - h) / 1e6 > 36000""",
    "retry_delays": """SELECT category, l_linenumber, retry, CASE WHEN retry THEN CAST(least(60, pow(2, l_linenumber - 1)) AS DOUBLE) END AS delay_seconds, count(*) AS n
        FROM (SELECT l_linenumber, CASE l_returnflag WHEN 'R' THEN 'RATE_LIMITED' WHEN 'A' THEN 'network_error' ELSE 'NO_TRANSCRIPT' END AS category, l_returnflag IN ('R', 'A') AND l_linenumber < 6 AS retry FROM lineitem) GROUP BY 1, 2, 3, 4""",
    "metrics_last100": """SELECT event_type, count(*) AS n, round(avg(value), 3) AS mean, min(value) AS least, max(value) AS most FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100) GROUP BY 1""",
    "usage_by_month": "SELECT l_returnflag, l_linestatus, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS month, sum(l_quantity) AS quantity, count(*) AS records FROM lineitem GROUP BY 1, 2, 3",
    "track_choice": "SELECT source_id, transcript_id, is_generated FROM raw_transcript WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY coalesce(is_generated, true), transcript_id) = 1",
    "routes": "SELECT item_id, 'video' AS route, left(source_id, 11) AS video_id, 'PL' || item_id AS playlist_id, 'none' AS link_problem FROM source_item",
    "uri_routes": """SELECT item_id, CASE WHEN NOT regexp_matches(uri, '^[a-zA-Z][a-zA-Z0-9+.-]*://') AND regexp_matches(lower(uri), '\\.(mp4|mkv|mov|webm|avi|m4v|flv|ts|wmv|mpeg|mpg|3gp)$') THEN 'file' ELSE 'unknown' END AS route,
        CASE WHEN coalesce(uri, '') = '' THEN 'empty' WHEN NOT regexp_matches(lower(uri), '^https?:') THEN 'scheme' ELSE 'none' END AS link_problem FROM source_item""",
    "display_names": "SELECT item_id, coalesce(nullif(title, ''), nullif(regexp_extract(file_path, '([^/]*?)(?:\\.[^./]*)?$', 1), ''), source_id) AS name FROM source_item",
}
