import datetime as dt

import pytest
from pyspark.sql import functions as F

from turnstone.operators import acquire as Q
from turnstone.operators import catalog as K
from turnstone.operators import control as J
from turnstone.session import current_rows
from turnstone.sinks import files as S

T0 = dt.datetime(2024, 1, 1)
JOBS = "job_id int, state string, priority int, created_at timestamp, attempt_count int, updated_at timestamp"


def jobs(spark):
    return spark.createDataFrame([(1, "QUEUED", 5, T0, 0, T0), (2, "QUEUED", 9, T0, 1, T0), (3, "COMPLETED", 9, T0, 1, T0), (4, "FAILED", 1, T0, 3, T0)], JOBS)


def states(df):
    return {r.job_id: r.state for r in df.collect()}


def test_queue_and_claim(spark):
    requests = spark.createDataFrame([(3,), (4,), (4,), (77,)], "job_id int")
    assert states(J.enqueue(jobs(spark), requests, F.current_timestamp())) == {1: "QUEUED", 2: "QUEUED", 3: "COMPLETED", 4: "QUEUED"}
    after, attempts = J.claim_leases(jobs(spark), 1, F.lit(T0))
    assert states(after) == {1: "QUEUED", 2: "ACCEPTED", 3: "COMPLETED", 4: "FAILED"}
    a = attempts.first()
    assert attempts.count() == 1 and (a.job_id, a.attempt_number, a.stage, a.completed_at) == (2, 2, "ACCEPTED", None)
    assert attempts.first().attempt_id == a.attempt_id and a.attempt_id.startswith("att_")
    assert J.claim_leases(jobs(spark).filter("state = 'FAILED'"), 5, F.lit(T0))[1].count() == 0
    assert states(J.cancel(jobs(spark), requests)) == {1: "QUEUED", 2: "QUEUED", 3: "COMPLETED", 4: "CANCELLED"}


def test_acknowledge_heartbeat_requeue(spark):
    s = lambda n: T0 + dt.timedelta(seconds=n)
    attempts = spark.createDataFrame([("a", 1, s(0), None, "ACCEPTED"), ("b", 2, s(0), None, "ACCEPTED"), ("c", 2, s(0), s(5), "FAILED")], "attempt_id string, job_id int, heartbeat_at timestamp, completed_at timestamp, stage string")
    beats = spark.createDataFrame([("a", s(9)), ("a", s(3)), ("c", s(9)), ("x", s(9))], "attempt_id string, at timestamp")
    assert {r.attempt_id: (r.heartbeat_at - T0).seconds for r in J.heartbeat(attempts, beats).collect()} == {"a": 9, "b": 0, "c": 0}
    acks = spark.createDataFrame([("b", "FAILED", "NETWORK_ERROR", s(1)), ("b", "COMPLETED", None, s(2)), ("x", "FAILED", "E", s(9))], "attempt_id string, final_state string, error_category string, at timestamp")
    after, ended = J.acknowledge(attempts, jobs(spark), acks)
    assert {r.attempt_id: r.stage for r in after.collect()} == {"a": "ACCEPTED", "b": "COMPLETED", "c": "FAILED"}
    assert states(ended)[2] == "COMPLETED" and states(ended)[1] == "QUEUED"
    lost = spark.createDataFrame([(1, "QUEUED"), (2, "QUEUED"), (2, "FAILED")], "job_id int, next_state string")
    back = {r.job_id: (r.state, r.error_code) for r in J.requeue(jobs(spark), lost).collect()}
    assert back[1] == ("QUEUED", None) and back[2] == ("FAILED", "MAX_RETRIES_EXCEEDED") and back[3] == ("COMPLETED", None)


def test_changes_lookups_details(spark):
    allowed = spark.createDataFrame([("QUEUED", "ACCEPTED")], "before string, after string")
    rows = spark.createDataFrame([("QUEUED", "ACCEPTED"), ("QUEUED", "QUEUED"), ("ACCEPTED", "QUEUED"), (None, "QUEUED")], "was string, now string")
    assert [tuple(r) for r in J.illegal_changes(rows, allowed, "was", "now").collect()] == [("ACCEPTED", "QUEUED")]
    assert J.found(rows, was=None).count() == 1 and J.found(rows, was="QUEUED", now="ACCEPTED").count() == 1
    found = spark.createDataFrame([(f"p{i:02d}", "missing") for i in range(13)] + [("q", "ok")], "path string, finding string")
    out = {r.finding: (r.shown, r.more) for r in J.first_details(found, "finding").collect()}
    assert out == {"missing": ([f"p{i:02d}" for i in range(10)], 3), "ok": (["q"], 0)}


def test_artifacts_and_lineage(spark):
    staged = spark.createDataFrame([("j", "s", "t/a.txt", bytearray(b"abc")), ("j", "s", "t/b.txt", bytearray(b"")), ("j", "s", "t/c.txt", None), ("j", "s", "../d.txt", bytearray(b"x"))], "job_id string, path string, target string, content binary")
    got = {r.storage_path: (r.state, r.problem, r.size_bytes) for r in J.promoted(staged).collect()}
    assert got == {"t/a.txt": ("READY", None, 3), "t/b.txt": ("REFUSED", "empty", 0), "t/c.txt": ("REFUSED", "missing", 0), "../d.txt": ("REFUSED", "outside", 1)}
    steps = spark.createDataFrame([("j", "RAW", ["a"], ["b"]), ("j", "RAW", ["a"], ["b"]), ("j", "EXPORT", ["b"], [])], "job string, stage string, i array<string>, o array<string>")
    rows = J.lineage(steps, "job", "stage", "i", "o", "1", "c")
    assert len({r.id for r in rows.collect()}) == 2
    one = J.execution_manifests(spark.createDataFrame([("j", "DONE"), ("k", "DONE")], "job_id string, status string"), rows.distinct(), J.promoted(staged).filter("state = 'READY'"))
    assert {r.job_id: (len(r.artifacts), [x.stage for x in r.lineage_stages]) for r in one.collect()} == {"j": (1, ["EXPORT", "RAW"]), "k": (0, [])}


def test_results_mark_the_state(spark):
    good = spark.createDataFrame([("a", "old", 1), ("b", "old", 1)], "source_id string, output_path string, at int")
    bad = spark.createDataFrame([("c", "X", 2, 1), ("a", "Y", 1, 0)], "source_id string, error_category string, retry_count bigint, at int")
    rows = [("a", "SUCCESS", None, "new", 5), ("c", "FAILED", "Z", None, 6), ("d", "FAILED", "W", None, 7), ("d", "FAILED", "V", None, 8), ("b", "FAILED", "U", None, 9), ("e", "FAILED", "U", None, 1), ("e", "SUCCESS", None, "p", 2), (None, "FAILED", "U", None, 1)]
    done, failed = K.mark_results(good, bad, spark.createDataFrame(rows, "source_id string, status string, error_category string, output_path string, at int"))
    assert {(r.source_id, r.output_path) for r in done.collect()} == {("a", "new"), ("b", "old"), ("e", "p")}
    assert {(r.source_id, r.error_category, r.retry_count) for r in failed.collect()} == {("c", "Z", 3), ("d", "V", 2), ("b", "U", 1)}


def test_tracks_and_acquisition(spark):
    tracks = spark.createDataFrame([("v", 1, "en-GB", True), ("v", 2, "EN", False), ("w", 3, "de", False), ("x", 4, "en", False), ("x", 5, "fr", None), (None, 6, "en", False)], "s string, t int, c string, g boolean")
    pick = lambda *a: {r.s: (r.t, r.error_category) for r in Q.choose_track(tracks, "s", "t", "c", "g", *a).collect()}
    assert pick() == {"v": (2, None), "w": (3, None), "x": (4, None)} and pick("auto", False)["v"] == (1, None)
    assert pick("en") == {"v": (2, None), "w": (None, "LANGUAGE_MISMATCH"), "x": (4, None)}
    assert pick("en-US") == {"v": (1, None), "w": (None, "LANGUAGE_MISMATCH"), "x": (None, "LANGUAGE_MISMATCH")}  # a bare code is not the wanted one
    sources = spark.createDataFrame([("l", "LOCAL_FILE", "/l"), ("m", "LOCAL_FILE", "/m"), ("u", "DIRECT_URL", None), ("n", "DIRECT_URL", None)], "source_id string, source_type string, file_path string")
    of = lambda *ids: spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "source_id string, transcript_id int")
    got = lambda p: {r.source_id: r.kind or r.error_category for r in Q.acquire(sources, of("u"), of("l"), of("l", "m", "u"), p).collect()}
    assert got("auto") == {"l": "EXTERNAL_FILE", "m": "LOCAL_STT", "u": "CAPTIONS", "n": "NO_TRANSCRIPT"}
    assert got("captions") == {"l": "EXTERNAL_FILE", "m": "NO_TRANSCRIPT", "u": "CAPTIONS", "n": "NO_TRANSCRIPT"}
    assert got("stt") == {"l": "LOCAL_STT", "m": "LOCAL_STT", "u": "NO_TRANSCRIPT", "n": "NO_TRANSCRIPT"}
    with pytest.raises(ValueError):
        got("other")


def test_current_rows_keep_nameless_rows(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 1), (None, "d", 1), (None, "c", 1)], "k int, x string, ingested_at int")
    assert sorted(r.x for r in current_rows(df, "k").collect()) == ["b", "c", "d"]


def test_pages(spark):
    seg = "array<struct<start double, end double, text string, speaker string, frames array<struct<timestamp double, frame_id string, file_path string, visual_type string, description string, confidence double>>>>"
    rows = [("s", "LOCAL_FILE", "u", None, "", "2024", [(0.0, 4.5, "Hello", "Ann", [(1.0, "f1", None, "sampled_frame", "", 0.345)]), (5.0, 61.0, "there", None, [])])]
    df = spark.createDataFrame(rows, f"source_id string, source_type string, uri string, title string, author string, upload_date string, segments {seg}")
    page = S.to_markdown(df).first().markdown
    assert page.startswith("# s\n\n- **Source ID**: `s`\n- **Platform**: `LOCAL_FILE`\n- **URI**: u\n- **Date**: 2024\n\n---\n\n### [00:00:00 - 00:00:04]\n**Ann**: Hello\n")
    assert "![Frame at 00:00:01](frame_f1)\n*Timestamp: 00:00:01 | Type: sampled_frame | Confidence: 0.34*\n" in page and page.endswith("there\n") and "Author" not in page
    import json

    doc = json.loads(S.to_multimodal_json(df).first().json)
    assert doc["visual_frame_count"] == 1 and doc["title"] == "s" and doc["segments"][1]["visual_frames"] == [] and doc["visual_frames"][0]["frame_id"] == "f1"
