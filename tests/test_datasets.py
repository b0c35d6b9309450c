import datetime as dt

import pytest
from pyspark.sql import functions as F

from turnstone import config, plugins
from turnstone.operators import align as A
from turnstone.operators import catalog as K
from turnstone.operators import dedup as D
from turnstone.operators import discovery as V
from turnstone.operators import queueing as Q
from turnstone.operators import report as R
from turnstone.plans.pipeline import process
from turnstone.sinks import files as out
from turnstone.sources import files as src
from turnstone.streaming import streams as S


def test_alignment(spark):
    seg = spark.createDataFrame([(1, "a", 0.0, 10.0), (2, "a", 10.0, 10.0), (3, "a", 20.0, 10.0), (9, "b", 5000.0, 1.0)], "seg_id bigint, source_id string, start double, duration double")
    frames = spark.createDataFrame([(f"f{i}", s, t) for i, (s, t) in enumerate([("a", 2.0), ("a", 8.5), ("a", 14.0), ("a", 25.0), ("a", 35.0), ("a", 10.0), ("b", 1.0), ("b", 9000.0), ("c", 1.0), ("a", None)])], "frame_id string, source_id string, timestamp double")
    got = {r.frame_id: (r.seg_id, r.contained) for r in A.align_frames(frames, seg, bucket_ms=7000).collect()}
    assert got == {"f0": (1, True), "f1": (1, True), "f2": (2, True), "f3": (3, True), "f4": (3, False), "f5": (1, True), "f6": (9, False), "f7": (9, False), "f8": (None, False)}


def test_spans_of_any_length(spark):
    """One corrupt end time neither explodes nor hides a pair; sweeps are those of a plain search."""
    import random

    r = random.Random(8)
    segs = [(i, r.choice("ab"), round(r.uniform(0, 3000), 3), r.choice([0.0, 2.5, 40.0, 900.0])) for i in range(60)] + [(900, "a", 5.0, 4e12), (901, "b", 100.0, 1e6)]
    frames = [(f"f{i}", r.choice("ab"), round(r.uniform(-50, 4000), 3)) for i in range(80)] + [("far", "a", 9e8), ("farther", "b", 9e8)]
    seg = spark.createDataFrame(segs, "seg_id bigint, source_id string, start double, duration double")
    fr = spark.createDataFrame(frames, "frame_id string, source_id string, timestamp double")
    ms = lambda x: round(x * 1000)
    pairs = {(f, g) for f, s, t in frames for g, v, a, d in segs if s == v and ms(a) <= ms(t) <= ms(a + d)}
    assert {(x.frame_id, x.seg_id) for x in A.frames_within(fr, seg, 5000).collect()} == pairs and ("far", 900) in pairs
    got = {x.frame_id: x.seg_id for x in A.align_frames(fr, seg, 5000).collect()}
    for f, s, t in frames:
        own = [(ms(a), ms(a + d), g) for g, v, a, d in segs if v == s]
        inside = [(a, g) for a, z, g in own if a <= ms(t) <= z]
        want = min(inside)[1] if inside else min((min(abs(ms(t) - a), abs(ms(t) - z)), a, g) for a, z, g in own)[2]
        assert got[f] == want
    talk = spark.createDataFrame([("a", "x", 0.0, 4e9), ("a", "y", 10.0, 20.0)], "source_id string, speaker string, start double, end double")
    best = {x.seg_id: (x.speaker, x.overlap_ms) for x in A.assign_speakers(seg, talk, 5000).collect()}
    assert best[900] == ("X", 4_000_000_000_000 - 5000) and best[901] == (None, 0)


def test_plans_of_frames_and_audio(spark):
    assert A.frame_interval(0.2) == 1.0 and [list(r[0]) for r in spark.createDataFrame([(1.0,)], "d double").select(A.frame_times("d", 0.25)).collect()] == [[0.0, 0.25, 0.5, 0.75]]
    rows = spark.createDataFrame([(25.0,), (0.0,), (None,), (1250.0,)], "d double").select(A.frame_times("d", 10.0), A.audio_pieces("d")).collect()
    assert [r[0] for r in rows][:3] == [[0.0, 10.0, 20.0], [], []] and [tuple(p) for p in rows[3][1]] == [(0.0, 600.0), (600.0, 600.0), (1200.0, 50.0)]


def test_speakers_by_overlap(spark):
    seg = spark.createDataFrame([(1, "a", 0.0, 10.0), (2, "a", 100.0, 1.0)], "seg_id bigint, source_id string, start double, duration double")
    talk = spark.createDataFrame([("a", "x ", 0.0, 3.0), ("a", "X", 4.0, 7.0), ("a", "y", 2.0, 7.5), ("a", None, 0.0, 10.0)], "source_id string, speaker string, start double, end double")
    assert {(r.seg_id, r.speaker, r.overlap_ms) for r in A.assign_speakers(seg, talk, 2500).collect()} == {(1, "X", 6000), (2, None, 0)}


def test_repeats(spark):
    ties = spark.createDataFrame([("a", 1, 7), ("a", 1, 8), ("a", 1, 7), ("b", None, 1), ("b", 2, 9), (None, 4, 1), (None, 5, 2)], "k string, o int, i int")
    assert sorted((str(r.k), r.i, r.is_repeat) for r in D.mark_repeats(ties, "k", "o", "i").collect()) == [("None", 1, False), ("None", 2, False), ("a", 7, False), ("a", 7, False), ("a", 8, True), ("b", 1, True), ("b", 9, False)]
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "k string, o int")
    assert {(r.k, r.o) for r in D.first_seen(df, "k", "o").collect()} == {("a", 1), ("b", 3), (None, 4)}
    docs = spark.createDataFrame([(1, "Same  TEXT"), (2, "same text "), (3, None), (4, "other")], "id int, t string")
    assert {(r.id, r.owner, r.status) for r in D.content_owner(docs, "id", "t", "id").collect()} == {(1, 1, "UNIQUE"), (2, 1, "POSSIBLE_DUPLICATE_CONTENT"), (3, 3, "UNIQUE"), (4, 4, "UNIQUE")}


def test_manifest_and_versions(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 10), ("b", 1, 20)], "source_id string, at int, word_count int")
    new = spark.createDataFrame([("b", 1, 21), ("c", 3, 30), ("c", 2, 31)], "source_id string, at int, word_count int")
    merged = K.upsert(old, new, "source_id", "at")
    assert {(r.source_id, r.word_count) for r in merged.collect()} == {("a", 10), ("b", 21), ("c", 30)}
    assert tuple(K.version_totals(merged).first()) == (3, 61)
    K.snapshot(merged, str(tmp_path), "v1.10")
    K.snapshot(merged, str(tmp_path), "v1.2")
    with pytest.raises(Exception, match="exist"):
        K.snapshot(merged, str(tmp_path), "v1.2")
    (tmp_path / "versions" / "v0").mkdir()
    assert [(r.version_tag, r.total_sources, r.total_words) for r in K.list_versions(spark, str(tmp_path)).collect()] == [("v0", None, None), ("v1.10", 3, 61), ("v1.2", 3, 61)]


def test_audit_and_repair(spark):
    sha = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    manifest = spark.createDataFrame([("a", "t/a.txt", sha("one"), 1, 3), ("b", "t/b.txt", sha("two"), 1, 3), ("c", "t/c.txt", sha("x"), 1, 1), ("d", "t/d.txt", sha(""), 0, 0)], "source_id string, output_path string, text_hash string, word_count bigint, character_count bigint")
    files = spark.createDataFrame([("t/a.txt", "one"), ("t/b.txt", "two changed"), ("t/d.txt", ""), ("t/new.txt", "n e w")], "path string, content string")
    found = K.audit(manifest, files.select("path", F.length("content").alias("size"), F.sha2("content", 256).alias("text_hash")))
    assert {(r.path, r.finding) for r in found.collect()} == {("t/a.txt", "ok"), ("t/b.txt", "modified"), ("t/c.txt", "missing"), ("t/d.txt", "empty"), ("t/new.txt", "unindexed")}
    frames = K.frame_findings(spark.createDataFrame([("f1",), ("f2",), ("f3",), ("",)], "path string"), spark.createDataFrame([("f1", 5), ("f2", 0)], "path string, size int"))
    health = K.health(found.unionByName(frames)).first()
    assert (health.valid, health.missing, health.empty, health.modified, health.unindexed, health.frames_missing, health.frames_empty, health.is_healthy) == (2, 1, 1, 1, 1, 1, 1, False)
    assert health.score == max(0, 100 - (20 + 20 + 15 + 5 + 5) * 100 // 4)
    fixed = {r.source_id: (r.action, r.word_count) for r in K.repair(manifest, files).collect()}
    assert fixed == {"a": ("kept", 1), "b": ("refreshed", 2), "c": ("kept", 1), "d": ("kept", 0), "new": ("indexed", 3)}


def test_report(spark):
    rows = spark.createDataFrame([(n,) for n in (100, 200, 300, 400, 500)], "n int")
    assert tuple(R.word_stats(rows, "n").first()) == (100, 500, 300.0, 300.0, 460.0) and tuple(R.word_stats(rows.limit(0), "n").first()) == (0, 0, 0.0, 0.0, 0.0)
    page = R.html_report("T <x>", {"words": 1234}, {"lang": [("en", 2, 100.0), ("<b>", 1, 50.0)]}, [{"title": "<i>"}] * 150)
    assert "1,234" in page and "<i>" not in page and page.count("&lt;i&gt;") == 100 and "http://" not in page


def test_queue(spark):
    jobs = spark.createDataFrame([(1, "QUEUED", 1, 5), (2, "QUEUED", 100, 9), (3, "QUEUED", 100, 8), (4, "DONE", 999, 1)], "job_id int, state string, priority int, created_at int")
    assert [r.job_id for r in Q.claim(jobs, workers=2).collect()] == [3, 2]
    now = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)
    attempts = spark.createDataFrame([(1, 1, now - dt.timedelta(seconds=120), None), (2, 2, now - dt.timedelta(seconds=10), None), (3, 3, now - dt.timedelta(seconds=999), now)], "attempt_id int, job_id int, heartbeat_at timestamp, completed_at timestamp")
    open_jobs = spark.createDataFrame([(1, "ACCEPTED", 1, 3), (2, "ACCEPTED", 1, 3), (3, "ACCEPTED", 3, 3)], "job_id int, state string, attempt_count int, max_attempts int")
    assert [tuple(r) for r in Q.recover(attempts, open_jobs, F.lit(now), 30, ["ACCEPTED"]).collect()] == [(1, 1, 120.0, "QUEUED", 2)]


def test_files(spark, tmp_path):
    (tmp_path / "v" / "deep").mkdir(parents=True)
    (tmp_path / "v" / "a b.mp4").write_bytes(b"x" * 20_000)
    (tmp_path / "v" / "deep" / "c.MKV").write_bytes(b"y")
    (tmp_path / "v" / "note.txt").write_text("# links\nhttps://youtu.be/dQw4w9WgXcQ  # one\n\n clips/a.mp4\n")
    (tmp_path / "v" / "a b.en.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n\n2\n00:00:03,000 --> 00:00:03,000\n<b></b>\n")
    (tmp_path / "v" / "a b.vtt").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nHi\n")
    videos = src.videos(spark, str(tmp_path / "v"))
    assert {(r.title, r.container_format) for r in videos.collect()} == {("a b", "mp4"), ("c", "mkv")}
    files = src.listing(spark, str(tmp_path / "v"))
    assert [r.subtitle.rsplit("/", 1)[1] for r in src.sibling_subtitles(videos, files).collect()] == ["a b.vtt"]
    assert [r.line for r in src.link_list(spark, str(tmp_path / "v" / "note.txt")).collect()] == ["https://youtu.be/dQw4w9WgXcQ", "clips/a.mp4"]
    subs = {r.path.rsplit(".", 2)[-2:][-1]: [(s.text, s.start, s.duration) for s in r.segments] for r in src.subtitles(spark, str(tmp_path / "v")).collect()}
    assert subs == {"srt": [("Hello there", 1.0, 1.5)], "vtt": [("Hi", 1.0, 1.0)]}
    rows = spark.createDataFrame([("x", "Same: title", "en"), ("y", "Same title", "en"), ("z", None, "en")], "source_id string, title string, language string")
    assert {r.source_id: r.target for r in out.target_names(rows, "language", "title", "source_id").collect()} == {"x": "en/Same_title", "y": "en/Same_title_y", "z": "en/z"}
    twice = spark.createDataFrame([("x", "Same", "en"), ("x", "Same", "en"), ("w", "Same", "en")], "source_id string, title string, language string")
    assert sorted(r.target for r in out.target_names(twice, "language", "title", "source_id").collect()) == ["en/Same", "en/Same_x", "en/Same_x_01"]
    assert {r.parent_collection for r in videos.collect()} == {"v", "deep"} and len({r.source_id for r in videos.collect()}) == 2
    assert [r.path.rsplit("/", 1)[1] for r in src.listing(spark, str(tmp_path / "v"), prefix="a b").collect()] == sorted(["a b.en.srt", "a b.mp4", "a b.vtt"])
    manifest = spark.createDataFrame([("x", "BAD", 4), ("x", "GOOD", 5)], "source_id string, quality string, word_count bigint").coalesce(1)
    out.write_manifest(manifest, str(tmp_path / "m"))
    back = src.manifest(spark, str(tmp_path / "m" / "manifest.json")).first()
    assert (back.source_id, back.quality_status, back.word_count, back.title) == ("x", "GOOD", 5, None)
    (tmp_path / "array.json").write_text('[\n {"source_id": "x", "word_count": 1},\n {"source_id": "y", "word_count": 2, "other": 3},\n {"source_id": "x", "word_count": 9}\n]')
    assert {(r.source_id, r.word_count) for r in src.manifest(spark, str(tmp_path / "array.json")).collect()} == {("x", 9), ("y", 2)}
    page = spark.createDataFrame([("p", "see /watch?v=aaa and v=bbb v=aaa")], "page string, text string")
    assert [tuple(r) for r in V.found_in_page(page, "page", "text", r"v=(\w+)", 500).collect()] == [("p", 1, "aaa"), ("p", 2, "bbb")]


def test_streams(spark, tmp_path):
    rows = [(i % 5, dt.datetime(2024, 1, 1, 0, 0, i, tzinfo=dt.timezone.utc), "m", i) for i in range(20)]
    df = spark.createDataFrame(rows, "key int, ts timestamp, metric string, value int")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    stream = lambda: S.table_stream(spark, str(tmp_path), "events", 1)
    assert S.run_available(S.first_deliveries(stream(), "key", "ts"), folder=str(tmp_path / "w1")).count() == 5
    closed = S.replayed(spark, str(tmp_path), "events", "ts", ["metric", "value"], files=3)
    sums = S.run_available(S.windowed_metrics(closed, "ts", "metric", "value", "10 seconds", delay="2 seconds"), str(tmp_path / "w2"))
    assert sorted(r.total for r in sums.collect()) == [45, 145]
    late = df.withColumn("ts", F.when(F.col("value") == 3, F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL 1 HOUR"))).orderBy("ts")
    late.filter("value <> 3 AND value < 15").coalesce(1).write.parquet(str(tmp_path / "late" / "a"))
    late.filter("value >= 15").coalesce(1).write.parquet(str(tmp_path / "late" / "a2"))
    late.filter("value = 3 OR value = 19").withColumn("ts", F.when(F.col("value") == 3, F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL 1 DAY"))).coalesce(1).write.parquet(str(tmp_path / "late" / "b"))
    both = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "late"))
    sums = S.run_available(S.windowed_metrics(both, "ts", "metric", "value", "10 seconds", delay="2 seconds"), str(tmp_path / "w3"))
    assert sorted(r.total for r in sums.collect()) == [42, 145]  # the row that came an hour late is in no window
    S.upsert_stream(stream(), str(tmp_path / "t"), "key", "ts", str(tmp_path / "cp"))
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "t" / "g=0")).collect()) == [15, 16, 17, 18, 19]


def test_plugins(spark):
    media = spark.createDataFrame([("a", None), ("b", bytearray(b"x"))], "source_id string, audio binary")
    rows = plugins.transcribe(media, "fixed", "de").collect()
    assert {(r.source_id, r.duration, r.language) for r in rows} == {("a", 4.5, "de"), ("b", 4.5, "de")} and 0 < rows[0].confidence <= 1
    sources = spark.createDataFrame([("a", 65.0), ("b", None)], "source_id string, duration_seconds double")
    assert [r.frame_id for r in plugins.describe_frames(sources, "sampled").collect()] == ["a_f0001", "a_f0002", "a_f0003"]
    assert plugins.describe_frames(sources).count() == 0
    with pytest.raises(KeyError, match="known: fixed"):
        plugins.transcribe(media, "other")


def test_search(spark):
    @plugins.SEARCH.register
    class Pages(plugins.SearchProvider):
        name = "pages"

        def pages(self, query):
            if query == "broken":
                raise OSError("no network")
            return [f"v=aa v=bb v=aa {query}", ""]

    assert [r.id for r in plugins.search(spark, "v=cc", r"v=(\w+)", "pages", 2).collect()] == ["aa", "bb"]
    assert plugins.search(spark, "broken", r"v=(\w+)", "pages").count() == 0


def test_config(tmp_path):
    assert [(config.load(profile=p).speech_model, config.load(profile=p).frame_interval_seconds) for p in ("fast", "balanced", "high-quality")] == [("tiny", 15.0), ("base", 10.0), ("medium", 5.0)]
    (tmp_path / "c.toml").write_text('[turnstone]\nmin_words = 5\ntarget_language = "en"\n')
    assert config.load(tmp_path / "c.toml", "fast", min_words=7) == config.Config(target_language="en", min_words=7, speech_model="tiny", frame_interval_seconds=15.0)
    with pytest.raises(ValueError, match="nothing"):
        config.load(nothing=1)
    assert [config.load(resume=x).resume for x in ("false", "0", "No", True, "yes")] == [False, False, False, True, True]
    with pytest.raises(ValueError, match="switch"):
        config.load(resume="perhaps")


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    sources, transcripts = spark.read.parquet(f"{d}/source_item.parquet"), spark.read.parquet(f"{d}/raw_transcript.parquet")
    run = process(sources, transcripts, config.Config(target_language="en"))
    n = run.counters.first()
    assert n.discovered == run.results.count() == n.processed + n.skipped + n.failed + n.language_mismatches + n.quality_failures
    assert run.manifest.count() == n.processed > 0 and run.manifest.filter("text_hash IS NULL OR dedup_status IS NULL").count() == 0
    again = process(sources, transcripts, config.Config(target_language="en"), done=run.manifest)
    assert again.counters.first().processed == 0
    frames = sources.select("source_id", F.explode(A.frame_times("duration_seconds", 60.0)).alias("t")).select("source_id", F.col("t").cast("string").alias("frame_id"))
    seen = process(sources, transcripts, config.Config(target_language="en"), frames=frames).counters.first()
    assert seen.total_visual_frames > 0 and seen.processed == n.processed
