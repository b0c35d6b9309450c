import random
from collections import defaultdict

from pyspark.sql import types as T
from turnstone.llm import turns
from turnstone.llm.speech import Roster, read_segment
from turnstone.llm.queries import p1_found
from turnstone.session import current_rows, table

SEGMENT = "seg_id bigint, source_id string, text string, start double, duration double, speaker string, extra string"
ROSTER = "speaker_id bigint, source_id string, full_name string, speaker_role string, diar_label string"
PEOPLE = [(1, "a", "Yarec Drovley", "host", "SPEAKER_01"), (2, "a", "Miringa Goststed", "guest", "SPEAKER_02"), (3, "a", "Pavec Fissoway", "guest", "SPEAKER_03")]


def brute(rows, roster):
    """Turns by one loop over the ordered stretches; rows are (source, start, seg, text, speaker)."""
    people = defaultdict(list)
    for sid, source, name, role, diar in roster:
        people[source].append((sid, name or "", role or "", diar or ""))
    out, source, who, first, last = [], None, None, None, None
    for s, start, seg, text, speaker in sorted(r for r in rows if r[0] is not None and r[1] is not None and r[3] is not None):
        for sid, _ in read_segment(text, speaker, Roster(people[s])):
            now = who if sid is None and s == source else sid
            if s != source or now != who:
                if first is not None:
                    out.append((source, first, last, who))
                source, who, first = s, now, seg
            last = seg
    if first is not None:
        out.append((source, first, last, who))
    return sorted((r for r in out if r[3] is not None), key=str)


def run(spark, rows, people=PEOPLE, **kw):
    seg = spark.createDataFrame([(g, s, t, st, 1.0, sp, "x") for s, st, g, t, sp in rows], SEGMENT)
    return turns.speaker_turns(seg, spark.createDataFrame(people, ROSTER), **kw)


def test_labels_and_words():
    r = Roster([x[:1] + x[2:] for x in PEOPLE])
    assert [r.resolve(x) for x in ("yarec_drovley", "Drovley, Yarec", "Y. Drovley", "S1", "spk01", "Speaker 1", "HOST", "Yarec Drvley", "Drovley (host)", "unknown", "guest", None)] == [1] * 9 + [None] * 3
    assert read_segment("[0:05] um So <i>we</i> go on. [Music]", "S2", r) == [(2, "So we go on.")]
    assert read_segment("the end\n>> Yarec: begin", None, r) == [(None, "the end"), (1, "begin")]
    assert read_segment("(Goststed) yes - HOST: no", "S3", r) == [(2, "yes"), (1, "no")]
    assert read_segment("00:00:12,500 --> [Applause] uh... hmm", "S1", r) == []
    assert read_segment("", "S1", r) == [] and read_segment("ben", "S1", r) == []
    assert len(read_segment("word: other " * 3000, None, r)) == 1 and len(read_segment("Yarec: one\nS2: two " * 500, None, r)) == 1000
    assert read_segment(">> unknown: we saw at 5:30", None, r)[0][0] is None


def test_rolling_captions():
    assert turns.merge_rolling(["hello everyone we will discuss", "we will discuss quantum mechanics", "quantum mechanics now"]) == ["hello everyone we will discuss", "quantum mechanics", "quantum mechanics now"]
    assert turns.merge_rolling([]) == [] and turns.merge_rolling([None, "a b"]) == ["", "a b"]


def test_labels_of_any_length():
    long = "Ana Maria de la Cruz Gomez y Hernandez von Hohenfels"
    r = Roster([(1, long, "", ""), (2, "Bo Li", "", ""), (3, "X" * 300 + " Smith", "", "")])
    assert read_segment(f"so it is {long}: hello", "Bo Li", r) == [(2, "so it is"), (1, "hello")]
    assert read_segment("word " * 400 + f"{long}: hello", None, r)[1] == (1, "hello")
    assert read_segment("X" * 300 + " Smith: yes", None, r) == [(3, "yes")]
    assert read_segment("[" + "x " * 200 + "] *" + "long note " * 20 + "* yes", "Bo Li", r) == [(2, "yes")]


def test_hot_sources_are_bounded_and_split(spark):
    rows = [("hot",)] * 500 + [(f"s{i}",) for i in range(500)] + [(None,)] * 5
    hot = turns.hot_sources(spark.createDataFrame(rows, "source_id string"), split=10)
    assert hot == {"hot": 20} and len(turns.hot_sources(spark.createDataFrame(rows, "source_id string"))) <= 1000
    rows = [("a", float(i), i, f"word {i}", "S1" if i % 2 else None) for i in range(50)]
    assert sorted(map(str, run(spark, rows, hot={"a": 7}).collect())) == sorted(map(str, run(spark, rows, hot={}).collect()))


def test_turns_across_buckets_ties_and_nulls(spark):
    rows = [
        ("a", 1.0, 5, "one two three", "S1"),
        ("a", 1.0, 6, "goes on", None),
        ("a", 700.0, 7, "still the same", "unknown"),
        ("a", 1900.0, 8, "new speaker", "S2"),
        ("a", 1901.0, 9, "hmm", "S1"),
        ("a", 1902.0, 10, "more", None),
        ("a", 2500.0, 11, "more again Yarec: back", ""),
        ("a", 3100.0, 12, "Pavec: third - Yarec: first", None),
        ("a", 3101.0, 13, "and on", None),
        ("a", None, 14, "no start", "S3"),
        ("a", 4000.0, 15, None, "S3"),
        ("b", 1.0, 16, "nobody knows", None),
        (None, 1.0, 17, "no source", "S1"),
    ]
    got = sorted(((r.source_id, r.first_seg_id, r.last_seg_id, r.speaker_id) for r in run(spark, rows).filter("speaker_id IS NOT NULL").collect()), key=str)
    assert got == brute(rows, PEOPLE)
    text = {r.first_seg_id: " ".join(u.text for u in r.utterances) for r in run(spark, rows).collect()}
    assert text[5] == "one two three goes on still the same" and text[16] == "nobody knows"


def test_pauses_split_turns_into_utterances(spark):
    rows = [("a", float(i), i, f"word {i}", "S1") for i in range(20)] + [("a", 60.0, 30, "after the pause", None), ("a", 1300.0, 31, "in another bucket", None)]
    out = run(spark, rows, pause_share=0.9)
    assert [(r.first_seg_id, r.last_seg_id, r.speaker_id, r.n_segments) for r in out.collect()] == [(0, 31, 1, 22)]
    said = turns.utterances(out).orderBy("start").collect()
    assert [(r.first_seg_id, r.last_seg_id, r.speaker_id, r.n_segments, r.text.split()[-1]) for r in said] == [(0, 19, 1, 20, "19"), (30, 30, 1, 1, "pause"), (31, 31, 1, 1, "bucket")]
    assert len(run(spark, rows, pause_share=None).first().utterances) == 1


def test_empty(spark):
    seg = spark.createDataFrame([], SEGMENT)
    assert turns.speaker_turns(seg, spark.createDataFrame([], ROSTER)).count() == 0


def test_whole_table_against_loop(spark):
    d = "/root/testdata/sf0.01"
    seg = current_rows(table(spark, d, "transcript_segment"), "seg_id").collect()
    roster = [(r.speaker_id, r.source_id, r.full_name, r.speaker_role, r.diar_label) for r in table(spark, d, "speaker_roster").collect()]
    expected = brute([(r.source_id, r.start, r.seg_id, r.text, r.speaker) for r in seg], roster)
    got = sorted((tuple(r) for r in p1_found(spark, d).collect()), key=str)
    assert got == expected
    assert isinstance(p1_found(spark, d).schema["speaker_id"].dataType, T.LongType)


def test_overlaps_of_any_length():
    words = [f"w{i}" for i in range(200)]
    for k in (40, 41, 90, 200):
        assert turns.merge_rolling([" ".join(words), " ".join(words[-k:]).upper() + " and on"]) == [" ".join(words), "and on"]
    assert turns.merge_rolling([" ".join(words)] * 3) == [" ".join(words), "", ""]
    r = random.Random(3)
    for _ in range(2000):
        a, b = ([r.choice("ab") for _ in range(r.randrange(12))] for _ in range(2))
        k = max((k for k in range(min(len(a), len(b)) + 1) if a[len(a) - k :] == b[:k]), default=0)
        assert turns._overlap(a, b) == k
        assert turns.merge_rolling([" ".join(a), " ".join(b)]) == [" ".join(a), " ".join(b[k if k >= 3 else 0 :])]


def test_found_turns_are_built_with_their_texts(spark):
    """The planner cannot leave the texts out: the islands are written with their utterances."""
    plan = p1_found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "utterances" in plan
