import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from turnstone.operators.intervals import merge_intervals, speaking_periods

S = "source_id string, speaker string, s bigint, e bigint, kind string, b string"


def brute(rows):
    groups, out = {}, []
    for src, spk, s, e, *_ in rows:
        if None not in (src, spk, s, e) and e > s:
            groups.setdefault((src, spk), []).append((s, e))
    for key, iv in groups.items():
        merged = []
        for s, e in sorted(iv):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(*key, "period", s, e) for s, e in merged]
        out += [(*key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out)


def run(spark, rows, bucket=100):
    out = merge_intervals(spark.createDataFrame(rows, S), ["source_id", "speaker"], "s", "e", bucket)
    return sorted((r.source_id, r.speaker, r.kind, r.start_ms, r.end_ms) for r in out.collect())


def test_random_intervals(spark):
    r = random.Random(7)
    rows = []
    for _ in range(1500):
        s = r.randrange(-500, 5000)
        rows.append((r.choice(["a", "b", None]), r.choice(["x", "x", "x", "y"]), s, s + r.choice([-3, 0, 1, 5, 5, 40, 700]), "k", "b"))
    for bucket in (50, 1000, 10_000_000):
        assert run(spark, rows, bucket) == brute(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-5, 60)), max_size=25))
def test_any_intervals(spark, pairs):
    rows = [("a", "x", s, s + d, "", "") for s, d in pairs]
    assert run(spark, rows, 7) == brute(rows)


def test_edges(spark):
    rows = [("a", "x", 0, 10, "", ""), ("a", "x", 10, 20, "", ""), ("a", "x", 20, 20, "", ""), ("a", "x", 25, 24, "", ""), ("a", "x", None, 9, "", ""), ("a", None, 1, 9, "", ""), ("a", "x", 21, 22, "", ""), ("a", "x", 21, 22, "", "")]
    assert run(spark, rows) == [("a", "x", "gap", 20, 21), ("a", "x", "period", 0, 20), ("a", "x", "period", 21, 22)]
    assert run(spark, []) == []


def test_hot_key_and_copies(spark):
    rows = [("hot", "x", i % 50 * 30, i % 50 * 30 + 20, "", "") for i in range(5000)] + [("hot", "x", 0, 1000, "", "")]
    assert run(spark, rows) == brute(rows)


def test_speakers_and_float_times(spark):
    rows = [("a", " speaker_01", 0.1 + 0.2, 1.0), ("a", "Speaker_01 ", 1.0000004, 2.0), ("a", "SPEAKER_01", float("nan"), 3.0), ("a", "x", 5.0, float("inf"))]
    out = speaking_periods(spark.createDataFrame(rows, "source_id string, speaker string, start double, end double")).collect()
    assert [tuple(r) for r in out] == [("a", "SPEAKER_01", "period", 300, 2000)]
