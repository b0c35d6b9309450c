import html

import xxhash
from pyspark.sql import functions as F

from turnstone.functions import hashing as H
from turnstone.functions import text as X
from turnstone.functions import timing as TM
from turnstone.functions import urls as U


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def test_words_follow_unicode_white_space(spark):
    for text in ("a b　c\x1cd\x85e  f", "", "  ", None, "one"):
        assert one(spark, X.words("x"), text) == (text or "").split()
        assert one(spark, X.word_count("x"), text) == len((text or "").split())
    assert one(spark, X.strip("x"), "  a b ") == "a b"


def test_entities_and_tags(spark):
    text = "Velocity &amp; Acceleration: What&#39;s the &quot;difference&quot;? 5 &gt; 3 &amp;&amp; 2 &lt; 4. &eacute;"
    assert one(spark, X.unescape_entities("x"), text) == html.unescape(text)
    assert one(spark, X.unescape_basic("x"), text).startswith("Velocity & Acceleration: What's the \"difference\"? 5 > 3 && 2 < 4.")
    got = one(spark, X.single_spaced(X.remove_sound_tags("x")), "Welcome to the presentation [Music] where we will [Applause] demonstrate the results.")
    assert got == "Welcome to the presentation where we will demonstrate the results."


def test_ratios(spark):
    assert one(spark, X.repetition_ratio(X.words("x")), "a b c a b c a b c") == 4 / 7
    assert one(spark, X.repetition_ratio(X.words("x")), "a b") == 0.0
    assert one(spark, X.abnormal_ratio("x"), "ab�\x07") == 0.5 and one(spark, X.abnormal_ratio("x"), "a b\n\tc") == 0.0
    assert one(spark, X.latin_ratio("x"), "abпр") == 0.5 and one(spark, X.latin_ratio("x"), "123") is None
    assert one(spark, X.ascii_tokens("x"), "The ok don't é_x a1 I") == ["the", "ok", "don"]


def test_hashes(spark):
    for text in ("", "abc", "Ünïcode and more than thirty-two bytes of text"):
        assert one(spark, H.xxh64("x"), text) == xxhash.xxh64_hexdigest(text) == one(spark, H._xxh64_batches(0)("x"), text)
    a, b = "This is a test transcript sentence.", "  THIS  is a\ttest transcript\n sentence. "
    assert one(spark, H.normalized_hash("x"), a) == one(spark, H.normalized_hash("x"), b) and one(spark, H.sha256("x"), a) != one(spark, H.sha256("x"), b)
    assert one(spark, H.xxh64("x"), None) is None
    assert H.config_hash({"b": 1, "a": 2, "workers": 4}) == H.config_hash({"a": 2, "b": 1, "workers": 9, "force": True})
    assert one(spark, H.stable_id("chk_", "x"), "t").startswith("chk_") and len(one(spark, H.stable_id("chk_", "x"), None)) == 16


def test_times(spark):
    shown = lambda v, m=",": one(spark, TM.clock("x", m), v, "double")
    assert (shown(1.5), shown(3.5, "."), shown(999.9996)) == ("00:00:01,500", "00:00:03.500", "00:16:39,1000")
    assert [one(spark, TM.clock_short("x"), v, "double") for v in (0.0, 65.0, 3665.0)] == ["00:00:00", "00:01:05", "01:01:05"]
    assert [one(spark, TM.seconds_of("x"), v) for v in ("00:01:23,456", "01:23.5", "7", "a:b")] == [83.456, 83.5, 7.0, None]
    assert [one(spark, TM.backoff("x"), v, "int") for v in (1, 2, 3, 20)] == [1.0, 2.0, 4.0, 60.0]
    assert [one(spark, TM.confidence_of("x"), v, "double") for v in (0.5, -1e9)] == [1.0, 0.0]


def test_links(spark):
    good = ["dQw4w9WgXcQ", "https://www.youtube.com/watch?v=dQw4w9WgXcQ", "https://youtu.be/dQw4w9WgXcQ?t=3", "https://www.youtube.com/embed/dQw4w9WgXcQ", "https://youtube.com/shorts/dQw4w9WgXcQ", "https://www.youtube.com/live/dQw4w9WgXcQ", "https://music.youtube.com/x?a=1&v=dQw4w9WgXcQ"]
    assert all(one(spark, U.video_id("x"), g) == "dQw4w9WgXcQ" for g in good)
    assert all(one(spark, U.video_id("x"), b) is None for b in ("short", "https://example.com/x", "", None))
    bad = ["http://127.0.0.1/", "http://localhost:8080", "http://169.254.169.254/latest", "http://10.0.0.1", "http://192.168.1.1", "ftp://x.org", "file:///etc/passwd", "javascript:alert(1)", "http://user:pass@x.org", "http://x.org:22", "http://x.org:6379", "http://[::1]/", "http://[fe80::1]/", ""]
    assert all(one(spark, U.link_problem("x"), b) is not None for b in bad)
    assert one(spark, U.link_problem("x"), "https://example.org/a?b=c") is None
    routes = {"clips/a.mkv": "file", "https://www.youtube.com/playlist?list=PL1": "playlist", "https://youtu.be/dQw4w9WgXcQ": "video", "hello": "unknown"}
    assert {k: one(spark, U.route("x"), k) for k in routes} == routes


def test_names_and_secrets(spark):
    names = {"CON": "safe_CON", "prn": "safe_prn", "aux.txt": "safe_aux.txt", "What is AI? (Part 1/2)": "What_is_AI_(Part_12)", "": "transcript", "a" * 99: "a" * 80}
    assert {k: one(spark, X.file_name("x"), k) for k in names} == names
    paths = {"../outside.txt": True, "transcripts/../../etc/passwd": True, "a\x00b": True, "/abs": True, "a/../b": False, "a/b.txt": False}
    assert {k: one(spark, X.escapes_root("x"), k) for k in paths} == paths
    secret = "key tx_live_" + "a1" * 12 + " and Bearer abc.def"
    assert one(spark, X.redact("x"), secret) == "key [REDACTED_SECRET] and [REDACTED_SECRET]"
    assert one(spark, X.content_type(F.lit("a/b.JPG"))) == "image/jpeg"
