import random

from turnstone.operators import captions as C
from turnstone.operators import gates as G
from pyspark.sql import functions as F

S = f"id int, segments {C.SEGMENTS}, raw_text string"


def frame(spark, rows):
    return spark.createDataFrame([(i, [(t, a, d, None, p) for t, a, d, p in seg] if seg is not None else None, raw) for i, (seg, raw) in enumerate(rows)], S)


def loop(texts, most=8):
    out, prev = [], []
    for t in texts:
        now = t.split()
        k = next((k for k in range(min(len(prev), len(now), most), 0, -1) if [w.lower() for w in prev[-k:]] == [w.lower() for w in now[:k]]), 0)
        if now[k:]:
            out += now[k:]
            prev = now
    return " ".join(out)


def test_rolling_captions(spark):
    r = random.Random(5)
    cases = [["hello everyone today we will discuss", "will discuss quantum mechanics", "quantum mechanics and wave functions"], ["a b", "A B", "b c", ""], []]
    cases += [[" ".join(r.choice("abc") for _ in range(r.randrange(0, 7))) for _ in range(12)] for _ in range(40)]
    df = frame(spark, [([(t, 0.0, 1.0, None) for t in c], "") for c in cases])
    got = [x[0] for x in df.orderBy("id").select(F.array_join(F.flatten(C.deflickered("segments")), " ")).collect()]
    assert got[0] == "hello everyone today we will discuss quantum mechanics and wave functions"
    assert got == [loop(c) for c in cases]


def test_paragraphs(spark):
    words = [f"w{i}." if i % 7 == 0 else f"w{i}" for i in range(400)]
    text = frame(spark, [(None, " ".join(words)), (None, ""), (None, None), (None, "one")]).orderBy("id").select(C.normal_text("segments", "raw_text", 150)).collect()
    parts = text[0][0].split("\n\n")
    assert " ".join(parts).split() == words and all(p.endswith(".") and len(p.split()) >= 150 for p in parts[:-1])
    assert [t[0] for t in text[1:]] == ["", "", "one"]


def test_subtitles(spark):
    df = frame(spark, [([("Hello <i>there</i>", 1.5, 2.0, None), ("Next one", 3661.25, 0.5, None)], "")])
    srt = df.select(C.to_srt("segments")).first()[0]
    assert srt == "1\n00:00:01,500 --> 00:00:03,500\nHello <i>there</i>\n\n2\n01:01:01,250 --> 01:01:01,750\nNext one\n"
    vtt = df.select(C.to_vtt("segments")).first()[0]
    assert vtt.startswith("WEBVTT\n\n00:00:01.500 --> 00:00:03.500\n")
    for text in (srt, vtt):
        back = spark.createDataFrame([(text,)], "x string").select(C.parse_cues("x")).first()[0]
        assert [(b.text, b.start, b.duration) for b in back] == [("Hello there", 1.5, 2.0), ("Next one", 3661.25, 0.5)]
    assert spark.createDataFrame([("no cues",)], "x string").select(C.parse_cues("x")).first()[0] == []


def test_packing(spark):
    seg = [(" ".join(["w"] * n), float(i * 10), 10.0, p) for i, (n, p) in enumerate([(8, "b"), (10, "a"), (0, "z"), (9, "a"), (30, None), (2, "c")])]
    got = frame(spark, [(seg, ""), ([], ""), (None, "")]).orderBy("id").select(C.packed("segments", 12)).collect()
    assert [(c.n_words, c.start, c.end, c.speaker) for c in got[0][0]] == [(8, 0.0, 10.0, "b"), (10, 10.0, 20.0, "a"), (9, 30.0, 40.0, "a"), (30, 40.0, 50.0, None), (2, 50.0, 60.0, "c")]
    assert got[1][0] == [] and got[2][0] == []


def test_quality(spark):
    texts = ["Just a very short clip with nine simple words here.", "subscribe to my channel " * 30, "", None, " ".join(f"word{i}" for i in range(60)), "�" * 200 + " a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", G.quality("t", F.lit(0), F.lit(None).cast("double")).alias("q")).orderBy("id").collect()
    assert [(r.q.status, r.q.is_usable) for r in rows] == [("SHORT", False), ("SUSPICIOUS", True), ("EMPTY", False), ("EMPTY", False), ("GOOD", True), ("SUSPICIOUS", True)]
    assert rows[1].q.repeated / rows[1].q.grams > 0.35


def test_language_gate(spark):
    english = "the cat is on the mat and we were there with all of them before it was over and so on"
    cases = [(english, "en", True, "en"), (english, "es", False, "es"), ("यह एक वाक्य है", None, False, "non_latin_script"), ("kya hai yeh bahut accha hai lekin hum nahi karenge bhai", "en", False, "hinglish"), (" ".join(f"zork{'abcdefghijklmnopqrstuvwxyz'[i % 26]}" for i in range(25)), "", False, "low_english_density"), ("  ", "en", False, "unknown")]
    df = spark.createDataFrame([(i, t, c) for i, (t, c, *_) in enumerate(cases)], "id int, t string, c string")
    rows = df.orderBy("id").select(G.language_decision("t", "c", "en").alias("d")).collect()
    assert [(r.d.is_acceptable, r.d.detected_language) for r in rows] == [c[2:] for c in cases]
    auto = df.orderBy("id").select(G.language_decision("t", "c").alias("d")).collect()
    assert [r.d.detected_language for r in auto] == ["en", "es", "unknown", "en", "unknown", "unknown"]
