"""Registered queries on acquisition, the job queue, lineage, artifacts and multimodal pages, with their SQL.

The tables at hand stand in for those of a running service; each query says which.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import hashing as H
from turnstone.functions import text as X
from turnstone.functions import timing as TM
from turnstone.functions import urls as U
from turnstone.operators import acquire as Q
from turnstone.operators import align as A
from turnstone.operators import captions as C
from turnstone.operators import catalog as K
from turnstone.operators import control as J
from turnstone.operators import discovery as V
from turnstone.operators import queueing as G
from turnstone.operators import report as R
from turnstone.plans import dataset_queries as D
from turnstone.plans.dataset_queries import _pick
from turnstone.session import current_rows, table
from turnstone.sinks import files as S

_DAY = "2024-01-31 00:00:00"


def _at():
    return F.to_timestamp(F.lit(_DAY))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs."""
    state = F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("org_id"), state.alias("state"), (6 - F.left("o_orderpriority", F.lit(1)).cast("int")).alias("priority"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), (F.col("o_custkey") % 3).cast("int").alias("attempt_count")
    )


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as attempts of their order's job."""
    rows = table(spark, sf_dir, "lineitem")
    attempt = F.concat_ws("-", *[F.col(c).cast("long").cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")])
    return rows.select(attempt.alias("attempt_id"), F.col("l_orderkey").alias("job_id"), F.col("l_shipdate").cast("timestamp").alias("heartbeat_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit("ACCEPTED").alias("stage"), "l_returnflag", "l_linestatus", "l_quantity")


def jobs_enqueued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with a returned item are queued again."""
    requests = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id"))
    return J.enqueue(_jobs(spark, sf_dir), requests, _at()).select("job_id", "state", "updated_at")


def lease_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.claim_leases(_jobs(spark, sf_dir), 40, _at())[1].select("attempt_id", "job_id", "attempt_number", "worker_id", "heartbeat_at", "stage")


def jobs_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.claim_leases(_jobs(spark, sf_dir), 40, _at())[0].groupBy("state").agg(F.count("*").alias("n"), F.sum("attempt_count").alias("attempts"))


def attempts_beaten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the status F beat ten days after they were shipped, with O ten days before."""
    rows = _attempts(spark, sf_dir)
    days = F.when(F.col("l_linestatus") == "F", 10).otherwise(-10)
    beats = rows.select("attempt_id", (F.unix_micros("heartbeat_at") + days * 86_400_000_000).alias("us")).select("attempt_id", F.timestamp_micros("us").alias("at"))
    return J.heartbeat(rows, beats).select("attempt_id", "heartbeat_at")


def _acknowledged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items that are not N acknowledge their attempt."""
    rows = _attempts(spark, sf_dir)
    bad = F.col("l_returnflag") == "R"
    acks = rows.filter("l_returnflag <> 'N'").select("attempt_id", F.when(bad, "FAILED").otherwise("COMPLETED").alias("final_state"), F.when(bad, "NETWORK_ERROR").alias("error_category"), F.col("heartbeat_at").alias("at"))
    return J.acknowledge(rows, _jobs(spark, sf_dir), acks)


def attempts_acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _acknowledged(spark, sf_dir)[0].select("attempt_id", "completed_at", "stage", "error_category")


def jobs_acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _acknowledged(spark, sf_dir)[1].select("job_id", "state", "error_code")


def jobs_requeued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts without a beat for 60 days of 2024-01-31 lose their lease; a job fails if it has no attempt left."""
    jobs = _jobs(spark, sf_dir).withColumn("max_attempts", F.lit(2))
    lost = G.recover(_attempts(spark, sf_dir), jobs, _at(), 60 * 86_400, ["QUEUED", "FAILED"])
    return J.requeue(jobs, lost).select("job_id", "state", "error_code")


def jobs_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("job_id"))
    return J.cancel(_jobs(spark, sf_dir), requests).select("job_id", "state", "cancelled")


def illegal_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' successive events as changes of state; signup, view, click and purchase may follow in this order."""
    from pyspark.sql.window import Window

    steps = ["signup", "view", "click", "purchase"]
    allowed = spark.createDataFrame([(a, b) for i, a in enumerate(steps) for b in steps[i + 1 :]], "before string, after string")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("was"), F.col("event_type").alias("now"))
    return J.illegal_changes(rows, allowed, "was", "now")


def jobs_of_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.found(_jobs(spark, sf_dir), org_id=7, state="QUEUED").select("job_id", "priority")


def items_of_failed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as artifacts of jobs."""
    failed = J.found(_jobs(spark, sf_dir), state="FAILED")
    return J.belonging(_attempts(spark, sf_dir), "job_id", failed, "job_id").select("attempt_id", "job_id")


def retryable_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.categories(spark)


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's transcripts, from raw text to text with a line end, as steps."""
    rows = table(spark, sf_dir, "raw_transcript").filter("source_id IS NOT NULL AND raw_text IS NOT NULL").select("source_id", "raw_text").distinct()
    return J.lineage(rows.select("source_id", F.lit("NORMALIZED").alias("stage"), F.array(H.sha256("raw_text")).alias("i"), F.array(H.sha256(F.concat("raw_text", F.lit("\n")))).alias("o")), "source_id", "stage", "i", "o", "1.0.0", "cfg")


def lineage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("id", "job_id", "stage", F.array_join("input_hashes", ",").alias("input_hashes"), F.array_join("output_hashes", ",").alias("output_hashes"), "pipeline_version", "config_hash")


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts as staged files; those of speech recognition want to leave the store."""
    rows = table(spark, sf_dir, "raw_transcript").select("transcript_id", "source_id", "transcript_source", "raw_text").distinct()
    name = F.concat(F.when(F.col("transcript_source") == "LOCAL_STT", "../").otherwise("texts/"), F.col("transcript_id").cast("string"), F.lit(".txt"))
    return rows.select(F.col("source_id").alias("job_id"), F.lit("staging").alias("path"), name.alias("target"), F.encode("raw_text", "UTF-8").alias("content"))


def artifacts_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.promoted(_staged(spark, sf_dir)).select("artifact_id", "storage_path", "content_hash", "size_bytes", "state", "problem")


def execution_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "raw_transcript").filter("source_id IS NOT NULL").select(F.col("source_id").alias("job_id"), F.lit("DONE").alias("status")).distinct()
    out = J.execution_manifests(jobs, _steps(spark, sf_dir), J.promoted(_staged(spark, sf_dir)).filter("state = 'READY'"))
    pairs = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[a], x[b])), ",")
    return out.select("execution_id", "job_id", "status", pairs("artifacts", "artifact_id", "content_hash").alias("artifacts"), pairs("lineage_stages", "stage", "id").alias("stages"))


def finding_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.first_details(D._audited(spark, sf_dir), "finding").select("finding", F.array_join("shown", ",").alias("shown"), "more")


def _marked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users' errors and purchases as results; those before 2024-01-16 make the state, the later ones the batch."""
    e = table(spark, sf_dir, "events").filter("event_type IN ('error', 'purchase')")
    rows = e.select(F.col("user_id").alias("source_id"), F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"), F.when(F.col("event_type") == "error", F.concat(F.lit("E"), (F.col("event_id") % 3).cast("string"))).alias("error_category"), F.col("event_id").cast("string").alias("output_path"), F.col("ts").cast("timestamp").alias("at"))
    none = rows.filter("false")
    early = K.mark_results(none.select("source_id", "output_path", "at"), none.select("source_id", "error_category", F.lit(0).cast("bigint").alias("retry_count"), "at"), rows.filter("at < timestamp'2024-01-16'"))
    return K.mark_results(*early, rows.filter("at >= timestamp'2024-01-16'"))


def state_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir)[0]


def state_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir)[1]


def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = _marked(spark, sf_dir)
    return good.select(F.lit("processed").alias("kind")).unionByName(bad.select(F.lit("failed").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a run with the word statistics of its successes, one row."""
    results = D._results(spark, sf_dir)
    words = R.word_stats(results.filter("status = 'SUCCESS'"), "word_count")
    return R.run_counters(results).crossJoin(F.broadcast(words.select(*[F.col(c).alias(f"words_{c}") for c in words.columns])))


def version_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.version_meta(D._manifest(spark, sf_dir, True), "v1", "talks", "1.0.0", H.config_hash({"language": "en", "workers": 4}))


def disk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.disk_totals(D._manifest(spark, sf_dir, True))


def totals_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as the manifest has them, else as the files have; here of an empty manifest and of a full one."""
    manifest = D._manifest(spark, sf_dir, True)
    return K.disk_totals(manifest).select(R.totals_or(F.lit(0).cast("long"), F.col("words")).alias("without"), R.totals_or(F.lit(12).cast("long"), F.col("words")).alias("with"))


def manifest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of the sources whose id ends in a."""
    return D._manifest(spark, sf_dir, True).filter(F.endswith("source_id", F.lit("a"))).select("source_id", "text_hash", "word_count")


def _choice(target: str, prefer_manual: bool = True):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "raw_transcript").select("source_id", "transcript_id", "language_code", "is_generated")
        return Q.choose_track(rows, "source_id", "transcript_id", "language_code", "is_generated", target, prefer_manual)

    return run


def _acquired(preference: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "raw_transcript").filter("source_id IS NOT NULL")
        first = lambda *kinds: rows.filter(F.col("transcript_source").isin(*kinds)).groupBy("source_id").agg(F.min("transcript_id").alias("transcript_id"))
        items = table(spark, sf_dir, "source_item").filter("source_id IS NOT NULL")
        return Q.acquire(items, first("MANUAL_CAPTIONS", "AUTO_CAPTIONS"), first("EXTERNAL_FILE"), first("LOCAL_STT"), preference)

    return run


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = current_rows(table(spark, sf_dir, "visual_frame").select("frame_id", "source_id", "timestamp", "file_path", "visual_type", "description", "confidence", "ingested_at"), "frame_id")
    segments = current_rows(table(spark, sf_dir, "transcript_segment").select("seg_id", "source_id", "text", "start", "duration", "speaker", "ingested_at"), "seg_id")
    return A.frames_by_segment(frames, segments)


def segment_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment with the frames that belong to it."""
    return _aligned(spark, sf_dir).select("source_id", "seg_id", F.size("frames").alias("n_frames"), F.array_join(F.transform("frames", lambda f: f["frame_id"]), ",").alias("frames"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their segments as pages; the panels' attributes follow from their ids."""
    one = F.struct("start", "seg_id", "end", "text", "speaker", "frames")
    rows = _aligned(spark, sf_dir).groupBy("source_id").agg(F.array_sort(F.collect_list(one)).alias("segments"))
    author = F.when(F.endswith("source_id", F.lit("a")), "").otherwise(F.concat(F.lit("by "), F.right("source_id", F.lit(3))))
    return rows.select("source_id", F.lit("DIRECT_URL").alias("source_type"), F.concat(F.lit("https://clips.example/w/"), "source_id").alias("uri"), F.lit(None).cast("string").alias("title"), author.alias("author"), F.lit("2024-02-01").alias("upload_date"), "segments")


def multimodal_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.to_markdown(_pages(spark, sf_dir))


def multimodal_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects, read again."""
    doc = F.from_json("json", "source_id string, title string, author string, visual_frame_count int, segments array<struct<start double, text string, visual_frames array<struct<frame_id string>>>>, visual_frames array<struct<frame_id string>>")
    rows = S.to_multimodal_json(_pages(spark, sf_dir)).select(doc.alias("d"))
    return rows.select("d.source_id", "d.title", "d.author", "d.visual_frame_count", F.size("d.segments").alias("n_segments"), F.array_join(F.transform("d.visual_frames", lambda f: f["frame_id"]), ",").alias("frames"), F.array_join(F.transform("d.segments", lambda s: F.coalesce(s["text"], F.lit(""))), "|").alias("texts"))


def vtt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written as VTT and read again."""
    rows = table(spark, sf_dir, "raw_transcript").filter("segments IS NOT NULL").select("transcript_id", F.explode(C.parse_cues(C.to_vtt("segments"))).alias("s"))
    return rows.select("transcript_id", TM.millis("s.start").alias("start_ms"), TM.millis("s.duration").alias("duration_ms"), "s.text")


def entities_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.unescape_entities(F.concat(F.lit("&eacute;&#233;&#xE9; &amp;lt; &hearts; &nbsp;"), F.col("p_partkey").cast("string"), F.lit(" &copy &unknown; 5 & 6"))).alias("text"))


def idempotency_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", H.idempotency_key(uri="o_orderkey", org="o_custkey", config=F.lit(H.config_hash({"b": 1, "a": [1, 2], "resume": True}))).alias("key"))


def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities from -10 to 1 as confidences, shown as percent."""
    p = TM.confidence_of(F.col("l_quantity") / 5 - 9)
    return table(spark, sf_dir, "lineitem").select("l_quantity").distinct().select("l_quantity", F.round(p, 6).alias("confidence"), X.percent(F.round(p, 2), 0).alias("shown"))


#: What comes after https:// in the links of ``link_checks``, by what speaks against each.
_LINKS = {
    "none": "clips.example/a", "credentials": "user:pw@clips.example/a", "localhost": "localhost/a", "port": "clips.example:6379/a", "network": "10.1.2.3/a", "v6": "[::1]/a", "edge": "172.31.255.255:8443/a", "outside": "172.32.0.1/a",
}


def link_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every kind, one for each nation and kind."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(x).alias("rest")) for k, x in _LINKS.items()])
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(kinds).alias("x"))
    link = F.concat(F.when(F.col("n_nationkey") % 5 == 0, "ftp://").otherwise("https://"), F.col("x.rest"), F.lit("?n="), F.col("n_nationkey").cast("string"))
    return rows.select("n_nationkey", "x.kind", F.coalesce(U.link_problem(link), F.lit("none")).alias("problem"))


def mixed_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of link, playlist, file and text, with an eleven-digit id of the part."""
    key = F.lpad(F.col("p_partkey").cast("string"), 11, "0")
    forms = ["https://youtu.be/{}", "https://www.youtube.com/watch?v={}&t=5", "youtube.com/shorts/{}", "https://m.youtube.com/watch?list=PLx&v={}", "https://www.youtube.com/playlist?list=PL{}", "/media/{}.MKV", "{}", "see {} there", "https://www.youtube.com/embed/{}", "https://youtube.com/live/{}"]
    at = F.col("p_partkey") % len(forms)
    line = F.replace(F.get(F.array(*map(F.lit, forms)), at.cast("int")), F.lit("{}"), key)
    return V.routed(table(spark, sf_dir, "part").select("p_partkey", line.alias("line")), "line").select("p_partkey", "route", "video_id", "playlist_id")


def listed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a link list, with comments and blanks, each source once in order of first appearance."""
    rows = table(spark, sf_dir, "part").withColumn("n", F.col("p_partkey") % 4)
    key = F.lpad((F.col("p_partkey") % 50).cast("string"), 11, "0")
    line = F.when(F.col("n") == 0, F.concat(F.lit("# note "), key)).when(F.col("n") == 1, F.concat(F.lit("  https://youtu.be/"), key, F.lit("  # seen"))).when(F.col("n") == 2, "   ").otherwise(F.concat(F.lit("https://youtu.be/"), key))
    return V.discovered(rows.select(F.col("p_partkey").alias("position"), line.alias("value")), "value", "position")


def missing_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of retrieval chunks against the frames' files; those without a description count as empty."""
    refs = table(spark, sf_dir, "retrieval_chunk").select(F.explode("associated_frame_paths").alias("path")).distinct()
    files = table(spark, sf_dir, "visual_frame").filter("file_path IS NOT NULL").groupBy(F.col("file_path").alias("path")).agg(F.max(F.coalesce(F.length("description"), F.lit(0))).alias("size"))
    return K.frame_findings(refs, files)


QUERIES = {
    name: globals()[name]
    for name in (
        "jobs_enqueued", "lease_rows", "jobs_claimed", "attempts_beaten", "attempts_acknowledged", "jobs_acknowledged", "jobs_requeued", "jobs_cancelled", "illegal_changes", "jobs_of_org", "items_of_failed_jobs", "retryable_errors",
        "lineage_rows", "artifacts_promoted", "execution_manifests", "finding_details", "state_processed", "state_failed", "state_counts", "run_stats", "version_meta", "disk_totals", "totals_with_fallback", "manifest_record",
        "segment_frames", "multimodal_markdown", "multimodal_json", "vtt_round_trip", "entities_decoded", "idempotency_keys", "confidences", "link_checks", "mixed_routes", "listed_inputs", "missing_frames",
    )
}
QUERIES |= {"track_auto": _choice("auto"), "track_en": _choice("en"), "track_en_us": _choice("en-US"), "track_generated": _choice("auto", False), "acquired_auto": _acquired("auto"), "acquired_captions": _acquired("captions"), "acquired_stt": _acquired("stt")}

_JOBS = """j AS (SELECT o_orderkey AS job_id, o_custkey AS org_id, CASE o_orderstatus WHEN 'O' THEN 'QUEUED' WHEN 'F' THEN 'COMPLETED' ELSE 'FAILED' END AS state, 6 - CAST(left(o_orderpriority, 1) AS INT) AS priority,
  o_orderdate AS created_at, CAST(o_custkey % 3 AS INT) AS attempt_count FROM orders),
a AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS attempt_id, l_orderkey AS job_id, l_shipdate AS beat, * FROM lineitem)"""
_TOP = "t AS (SELECT *, row_number() OVER (ORDER BY priority DESC, created_at, job_id) AS n FROM j WHERE state = 'QUEUED' QUALIFY n <= 40)"
_ID = "'{p}' || left(sha256(concat_ws(chr(31), {x})), 12)"
_LINEAGE = f"""n AS (SELECT {_ID.format(p='lin_', x="source_id, 'NORMALIZED', sha256(raw_text), sha256(raw_text || chr(10))")} AS id, source_id AS job_id, 'NORMALIZED' AS stage, sha256(raw_text) AS input_hashes, sha256(raw_text || chr(10)) AS output_hashes,
  '1.0.0' AS pipeline_version, 'cfg' AS config_hash FROM (SELECT DISTINCT source_id, raw_text FROM raw_transcript WHERE source_id IS NOT NULL AND raw_text IS NOT NULL))"""
_STAGED = f"""p AS (SELECT {_ID.format(p='art_', x="coalesce(job_id, ''), target")} AS artifact_id, job_id, target AS storage_path, sha256(x) AS content_hash, CAST(coalesce(strlen(x), 0) AS INT) AS size_bytes,
  CASE WHEN x IS NULL THEN 'missing' WHEN x = '' THEN 'empty' WHEN left(target, 3) = '../' THEN 'outside' END AS problem
  FROM (SELECT DISTINCT source_id AS job_id, raw_text AS x, CASE WHEN transcript_source = 'LOCAL_STT' THEN '../' ELSE 'texts/' END || transcript_id || '.txt' AS target FROM raw_transcript))"""
_EVENTS = """e AS (SELECT user_id AS source_id, event_type = 'error' AS bad, 'E' || (event_id % 3) AS cat, CAST(event_id AS VARCHAR) AS path, ts FROM events WHERE event_type IN ('error', 'purchase')),
w AS (SELECT *, max(CASE WHEN NOT bad THEN ts END) OVER (PARTITION BY source_id) AS won FROM e)"""
_FAILED = _EVENTS + ", f AS (SELECT source_id, arg_max(cat, ts) AS error_category, count(*) AS retry_count, max(ts) AS at FROM w WHERE bad AND (won IS NULL OR ts > won) GROUP BY 1), g AS (SELECT source_id, arg_max(path, ts) AS output_path, max(ts) AS at FROM w WHERE NOT bad GROUP BY 1)"
_NEAR = D._CUR.replace("source_id, file_path,", "source_id, file_path, visual_type, description, confidence, \"timestamp\",").replace("SELECT seg_id, source_id,", 'SELECT seg_id, source_id, text, speaker, "start", "start" + coalesce(duration, 0) AS "end",', 1).replace("SELECT seg_id, source_id, a,", 'SELECT seg_id, source_id, text, speaker, "start", "end", a,') + """,
al AS (SELECT fs.*, seg_id FROM fs JOIN ss ON fs.source_id = ss.source_id
  QUALIFY row_number() OVER (PARTITION BY fs.source_id, frame_id ORDER BY fs.t BETWEEN a AND z DESC, CASE WHEN fs.t BETWEEN a AND z THEN 0 ELSE least(abs(fs.t - a), abs(fs.t - z)) END, a, seg_id) = 1)"""
_SHOW = "printf('%02d:%02d:%02d', CAST(floor({s} / 3600) AS INT), CAST(floor((floor({s}) % 3600) / 60) AS INT), CAST(floor({s}) % 60 AS INT))"
_BY = "CASE WHEN ends_with(source_id, 'a') THEN '' ELSE 'by ' || right(source_id, 3) END"


def _track(target: str, prefer_manual: bool) -> str:
    fits = "true" if target == "auto" else f"coalesce(lower(language_code) = '{target.lower()}' OR starts_with(lower(language_code), '{target.lower().split('-')[0]}-'), false)"
    made = "coalesce(is_generated, true)"
    return f"""SELECT source_id, CASE WHEN {fits} THEN transcript_id END AS transcript_id, CASE WHEN NOT {fits} THEN 'LANGUAGE_MISMATCH' END AS error_category FROM raw_transcript WHERE source_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY NOT {fits}, {made if prefer_manual else 'NOT ' + made}, transcript_id) = 1"""


def _acquire(choice: str) -> str:
    return f"""WITH k AS (SELECT source_id, min(transcript_id) FILTER (WHERE transcript_source IN ('MANUAL_CAPTIONS', 'AUTO_CAPTIONS')) AS c, min(transcript_id) FILTER (WHERE transcript_source = 'EXTERNAL_FILE') AS b,
          min(transcript_id) FILTER (WHERE transcript_source = 'LOCAL_STT') AS h FROM raw_transcript WHERE source_id IS NOT NULL GROUP BY 1),
        s AS (SELECT DISTINCT source_id, file_path IS NOT NULL AS file, source_type = 'LOCAL_FILE' AND file_path IS NOT NULL AS local FROM source_item WHERE source_id IS NOT NULL),
        r AS (SELECT s.source_id, c, b, h, {choice} AS kind FROM s LEFT JOIN k ON s.source_id = k.source_id)
        SELECT source_id, kind, CASE kind WHEN 'CAPTIONS' THEN c WHEN 'EXTERNAL_FILE' THEN b WHEN 'LOCAL_STT' THEN h END AS transcript_id, CASE WHEN kind IS NULL THEN 'NO_TRANSCRIPT' END AS error_category FROM r"""


ORACLE = {
    "jobs_enqueued": f"""WITH {_JOBS}, q AS (SELECT *, state <> 'COMPLETED' AND job_id IN (SELECT job_id FROM a WHERE l_returnflag = 'R') AS hit FROM j)
        SELECT job_id, CASE WHEN hit THEN 'QUEUED' ELSE state END AS state, CASE WHEN hit THEN TIMESTAMP '{_DAY}' ELSE created_at END AS updated_at FROM q""",
    "lease_rows": f"""WITH {_JOBS}, {_TOP} SELECT {_ID.format(p='att_', x='CAST(job_id AS VARCHAR), CAST(attempt_count + 1 AS VARCHAR)')} AS attempt_id, job_id, attempt_count + 1 AS attempt_number, printf('worker-%04d', n) AS worker_id,
        TIMESTAMP '{_DAY}' AS heartbeat_at, 'ACCEPTED' AS stage FROM t""",
    "jobs_claimed": f"WITH {_JOBS}, {_TOP}, u AS (SELECT CASE WHEN t.job_id IS NULL THEN j.state ELSE 'ACCEPTED' END AS state, j.attempt_count + CASE WHEN t.job_id IS NULL THEN 0 ELSE 1 END AS c FROM j LEFT JOIN t ON j.job_id = t.job_id) SELECT state, count(*) AS n, CAST(sum(c) AS BIGINT) AS attempts FROM u GROUP BY 1",
    "attempts_beaten": f"WITH {_JOBS} SELECT attempt_id, CASE WHEN l_linestatus = 'F' THEN beat + INTERVAL 10 DAY ELSE beat END AS heartbeat_at FROM a",
    "attempts_acknowledged": f"""WITH {_JOBS} SELECT attempt_id, CASE WHEN l_returnflag <> 'N' THEN beat END AS completed_at, CASE l_returnflag WHEN 'N' THEN 'ACCEPTED' WHEN 'R' THEN 'FAILED' ELSE 'COMPLETED' END AS stage,
        CASE WHEN l_returnflag = 'R' THEN 'NETWORK_ERROR' END AS error_category FROM a""",
    "jobs_acknowledged": f"""WITH {_JOBS}, e AS (SELECT job_id, arg_max(l_returnflag, (beat, attempt_id)) AS f FROM a WHERE l_returnflag <> 'N' GROUP BY 1)
        SELECT j.job_id, CASE f WHEN 'R' THEN 'FAILED' WHEN 'A' THEN 'COMPLETED' ELSE state END AS state, CASE WHEN f = 'R' THEN 'NETWORK_ERROR' END AS error_code FROM j LEFT JOIN e ON j.job_id = e.job_id""",
    "jobs_requeued": f"""WITH {_JOBS}, l AS (SELECT DISTINCT a.job_id FROM a WHERE epoch_us(TIMESTAMP '{_DAY}' - beat) > 60 * 86400000000)
        SELECT j.job_id, CASE WHEN l.job_id IS NULL OR state = 'COMPLETED' THEN state WHEN attempt_count < 2 THEN 'QUEUED' ELSE 'FAILED' END AS state,
        CASE WHEN l.job_id IS NOT NULL AND state <> 'COMPLETED' AND attempt_count >= 2 THEN 'MAX_RETRIES_EXCEEDED' END AS error_code FROM j LEFT JOIN l ON j.job_id = l.job_id""",
    "jobs_cancelled": f"WITH {_JOBS}, q AS (SELECT *, state <> 'COMPLETED' AND job_id IN (SELECT job_id FROM a WHERE l_quantity > 45) AS cancelled FROM j) SELECT job_id, CASE WHEN cancelled THEN 'CANCELLED' ELSE state END AS state, cancelled FROM q",
    "illegal_changes": """WITH e AS (SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, event_type AS now FROM events),
        o AS (SELECT * FROM (VALUES ('signup', 1), ('view', 2), ('click', 3), ('purchase', 4)) AS x(s, n))
        SELECT e.* FROM e LEFT JOIN o p ON was = p.s LEFT JOIN o q ON now = q.s WHERE was <> now AND NOT coalesce(p.n < q.n, false)""",
    "jobs_of_org": f"WITH {_JOBS} SELECT job_id, priority FROM j WHERE org_id = 7 AND state = 'QUEUED'",
    "items_of_failed_jobs": f"WITH {_JOBS} SELECT attempt_id, job_id FROM a WHERE job_id IN (SELECT job_id FROM j WHERE state = 'FAILED')",
    "lineage_rows": f"WITH {_LINEAGE} SELECT * FROM n",
    "artifacts_promoted": f"WITH {_STAGED} SELECT artifact_id, storage_path, content_hash, size_bytes, CASE WHEN problem IS NULL THEN 'READY' ELSE 'REFUSED' END AS state, problem FROM p",
    "execution_manifests": f"""WITH {_LINEAGE}, {_STAGED}, x AS (SELECT DISTINCT source_id AS job_id FROM raw_transcript WHERE source_id IS NOT NULL),
        y AS (SELECT job_id, string_agg(artifact_id || ':' || content_hash, ',' ORDER BY artifact_id) AS s FROM p WHERE problem IS NULL GROUP BY 1), z AS (SELECT job_id, string_agg(stage || ':' || id, ',' ORDER BY stage, id) AS s FROM n GROUP BY 1)
        SELECT {_ID.format(p='exe_', x='x.job_id')} AS execution_id, x.job_id, 'DONE' AS status, coalesce(y.s, '') AS artifacts, coalesce(z.s, '') AS stages FROM x LEFT JOIN y ON x.job_id = y.job_id LEFT JOIN z ON x.job_id = z.job_id""",
    "finding_details": D._AUDIT + ", r AS (SELECT *, row_number() OVER (PARTITION BY finding ORDER BY path) AS n FROM x) SELECT finding, string_agg(path, ',' ORDER BY path) FILTER (WHERE n <= 10) AS shown, greatest(count(*) - 10, 0) AS more FROM r GROUP BY 1",
    "state_processed": f"WITH {_FAILED} SELECT * FROM g",
    "state_failed": f"WITH {_FAILED} SELECT * FROM f",
    "state_counts": f"WITH {_FAILED} SELECT 'processed' AS kind, count(*) AS n FROM g HAVING n > 0 UNION ALL SELECT 'failed', count(*) AS n FROM f HAVING n > 0",
    "run_stats": D.ORACLE["run_summary"].rpartition(" FROM r")[0] + """, coalesce(min(word_count) FILTER (WHERE cat IS NULL), 0) AS words_min, coalesce(max(word_count) FILTER (WHERE cat IS NULL), 0) AS words_max, round(coalesce(avg(word_count) FILTER (WHERE cat IS NULL), 0), 1) AS words_mean,
        round(coalesce(quantile_cont(word_count, 0.5) FILTER (WHERE cat IS NULL), 0), 1) AS words_p50, round(coalesce(quantile_cont(word_count, 0.9) FILTER (WHERE cat IS NULL), 0), 1) AS words_p90 FROM r""",
    "version_meta": f"SELECT 'v1' AS version_tag, 'talks' AS dataset_name, '1.0.0' AS pipeline_version, sha256('{{\"language\":\"en\"}}') AS config_hash, count(*) AS total_sources, CAST(sum(word_count) AS BIGINT) AS total_words FROM ({_pick('DESC')})",
    "disk_totals": f"SELECT count(*) AS files, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS words, CAST(coalesce(sum(character_count), 0) AS BIGINT) AS characters FROM ({_pick('DESC')}) WHERE content <> ''",
    "totals_with_fallback": f"SELECT CAST(sum(word_count) AS BIGINT) AS without, CAST(12 AS BIGINT) AS \"with\" FROM ({_pick('DESC')})",
    "manifest_record": f"SELECT source_id, text_hash, word_count FROM ({_pick('DESC')}) WHERE ends_with(source_id, 'a')",
    "segment_frames": f"WITH {_NEAR} SELECT ss.source_id, ss.seg_id, CAST(count(frame_id) AS INT) AS n_frames, coalesce(string_agg(frame_id, ',' ORDER BY \"timestamp\", frame_id), '') AS frames FROM ss LEFT JOIN al ON ss.source_id = al.source_id AND ss.seg_id = al.seg_id GROUP BY 1, 2",
    "multimodal_markdown": f"""WITH {_NEAR}, fr AS (SELECT source_id, seg_id, string_agg('![Frame at ' || {_SHOW.format(s='"timestamp"')} || '](' || coalesce(nullif(file_path, ''), 'frame_' || frame_id) || ')' || chr(10) || '*' ||
          concat_ws(' | ', 'Timestamp: ' || {_SHOW.format(s='"timestamp"')}, 'Type: ' || visual_type, 'Description: ' || nullif(description, ''), 'Confidence: ' || printf('%.2f', confidence)) || '*' || chr(10) || chr(10), '' ORDER BY "timestamp", frame_id) AS f FROM al GROUP BY 1, 2),
        sg AS (SELECT ss.source_id, string_agg('### [' || {_SHOW.format(s='"start"')} || ' - ' || {_SHOW.format(s='"end"')} || ']' || chr(10) || coalesce('**' || nullif(speaker, '') || '**: ', '') || coalesce(text, '') || chr(10) || chr(10) || coalesce(f, ''), '' ORDER BY "start", ss.seg_id) AS s
          FROM ss LEFT JOIN fr ON ss.source_id = fr.source_id AND ss.seg_id = fr.seg_id GROUP BY 1),
        pg AS (SELECT source_id, concat('# ', source_id, chr(10), chr(10), '- **Source ID**: `', source_id, '`', chr(10), '- **Platform**: `DIRECT_URL`', chr(10), '- **URI**: https://clips.example/w/', source_id, chr(10), '- **Author / Channel**: ' || nullif({_BY}, '') || chr(10),
          '- **Date**: 2024-02-01', chr(10), chr(10), '---', chr(10), chr(10), s) AS m FROM sg)
        SELECT source_id, regexp_replace(m, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+$', '') || chr(10) AS markdown FROM pg""",
    "multimodal_json": f"""WITH {_NEAR}, sf AS (SELECT ss.source_id, ss.seg_id, any_value("start") AS st, any_value(coalesce(text, '')) AS text, count(frame_id) AS n, string_agg(frame_id, ',' ORDER BY "timestamp", frame_id) AS f FROM ss LEFT JOIN al ON ss.source_id = al.source_id AND ss.seg_id = al.seg_id GROUP BY 1, 2)
        SELECT source_id, source_id AS title, {_BY} AS author, CAST(sum(n) AS INT) AS visual_frame_count, CAST(count(*) AS INT) AS n_segments, coalesce(string_agg(f, ',' ORDER BY st, seg_id), '') AS frames, string_agg(text, '|' ORDER BY st, seg_id) AS texts FROM sf GROUP BY 1""",
    "vtt_round_trip": """WITH s AS (SELECT transcript_id, unnest(segments) AS s FROM raw_transcript WHERE segments IS NOT NULL),
        c AS (SELECT transcript_id, CAST(round(s.start * 1000) AS BIGINT) AS start_ms, CAST(round((s.start + s.duration) * 1000) AS BIGINT) - CAST(round(s.start * 1000) AS BIGINT) AS duration_ms,
          trim(regexp_replace(regexp_replace(s.text, '<[^<>]*>', '', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g')) AS text FROM s) SELECT * FROM c WHERE text <> ''""",
    "entities_decoded": "SELECT p_partkey, 'ééé &lt; ♥ ' || chr(160) || p_partkey || ' © &unknown; 5 & 6' AS text FROM part",
    "idempotency_keys": "SELECT o_orderkey, sha256('{\"config\":\"' || sha256('{\"a\":[1,2],\"b\":1}') || '\",\"org\":\"' || o_custkey || '\",\"uri\":\"' || o_orderkey || '\"}') AS key FROM orders",
    "confidences": "SELECT DISTINCT l_quantity, round(least(1, exp(l_quantity / 5 - 9)), 6) AS confidence, printf('%.0f%%', round(least(1, exp(l_quantity / 5 - 9)), 2) * 100) AS shown FROM lineitem",
    "link_checks": """SELECT n_nationkey, kind, CASE WHEN n_nationkey % 5 = 0 THEN 'scheme' ELSE problem END AS problem FROM nation,
        (VALUES ('none', 'none'), ('credentials', 'credentials'), ('localhost', 'localhost'), ('port', 'port'), ('network', 'network'), ('v6', 'network'), ('edge', 'network'), ('outside', 'none')) AS k(kind, problem)""",
    "mixed_routes": """WITH p AS (SELECT p_partkey, p_partkey % 10 AS n, lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS k FROM part)
        SELECT p_partkey, CASE WHEN n = 4 THEN 'playlist' WHEN n = 5 THEN 'file' WHEN n = 7 THEN 'unknown' ELSE 'video' END AS route, CASE WHEN n NOT IN (4, 5, 7) THEN k END AS video_id, CASE n WHEN 3 THEN 'PLx' WHEN 4 THEN 'PL' || k END AS playlist_id FROM p""",
    "listed_inputs": """WITH p AS (SELECT p_partkey, lpad(CAST(p_partkey % 50 AS VARCHAR), 11, '0') AS k FROM part WHERE p_partkey % 4 IN (1, 3)) SELECT k AS source_id, 'video' AS route, min(p_partkey) AS position FROM p GROUP BY 1""",
    "missing_frames": """WITH r AS (SELECT DISTINCT unnest(associated_frame_paths) AS path FROM retrieval_chunk), f AS (SELECT file_path AS path, max(coalesce(length(description), 0)) AS size FROM visual_frame WHERE file_path IS NOT NULL GROUP BY 1)
        SELECT r.path, CASE WHEN f.path IS NULL THEN 'frame missing' WHEN size = 0 THEN 'frame empty' ELSE 'frame ok' END AS finding FROM r LEFT JOIN f ON r.path = f.path WHERE r.path <> ''""",
    "retryable_errors": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {str(r).lower()})" for c, r in J.CATEGORIES) + ") AS c(category, retryable)",
    "track_auto": _track("auto", True),
    "track_en": _track("en", True),
    "track_en_us": _track("en-US", True),
    "track_generated": _track("auto", False),
    "acquired_auto": _acquire("CASE WHEN NOT local AND c IS NOT NULL THEN 'CAPTIONS' WHEN local AND b IS NOT NULL THEN 'EXTERNAL_FILE' WHEN local AND h IS NOT NULL THEN 'LOCAL_STT' END"),
    "acquired_captions": _acquire("CASE WHEN NOT local AND c IS NOT NULL THEN 'CAPTIONS' WHEN local AND b IS NOT NULL THEN 'EXTERNAL_FILE' END"),
    "acquired_stt": _acquire("CASE WHEN file AND h IS NOT NULL THEN 'LOCAL_STT' END"),
}
