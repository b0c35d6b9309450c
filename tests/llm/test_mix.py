import math

from pyspark.sql import functions as F
from turnstone.llm.mix import mix, reached_shares, records, whole_uses
from turnstone.llm.tokens import encode_text

D = "doc_id bigint, text string, source string, tokens int, rate string"
T = "source string, target_share double, max_repeats int"


def brute(docs, targets):
    size = {}
    total = 0
    for _, t, s, *_ in docs:
        n = len(encode_text(t))
        total += n
        k = (s or "").strip().lower()
        size[k] = size.get(k, 0) + n
    return {s for s, share, cap in targets if size.get(s, 0) * cap < share * total}, size, total


TARGETS = [("a", 0.5, 2), ("b", 0.3, 10), ("c", 0.1, 1), ("none", 0.1, 3)]


def docs():
    rows = [(i, "some words about rivers and boats " * (1 + i % 4), " A " if i % 3 else "a", 1, "") for i in range(10)]
    rows += [(100 + i, "numbers in a table " * 2, "b", 1, "") for i in range(12)]
    rows += [(200 + i, "speech of many people in a hall " * 9, "C", 1, "") for i in range(30)]
    return rows + [(300, None, "a", 1, ""), (301, "", "b", 1, ""), (302, "rivers and boats", None, 1, ""), (303, "more", "  ", 1, ""), (304, "no target", "other", 1, ""), *rows[:3]]


def test_short_sources_and_shares(spark):
    rows = docs()
    short, size, total = brute(rows, TARGETS)
    for trust in (0.3, 0.75, 1.0):
        rates, report = mix(spark.createDataFrame(rows, D), spark.createDataFrame(TARGETS, T), trust=trust)
        rep = {r.source: r for r in report.collect()}
        assert {s for s, r in rep.items() if r.short} == short and set(rep) == {"a", "b", "c", "none"}
        assert all(r.corpus_tokens == total and r.own_tokens == size.get(s, 0) for s, r in rep.items())
        assert math.isclose(sum(r.fitted_share for r in rep.values()), 1.0)
        caps = {s: c for s, _, c in TARGETS}
        for s, r in rep.items():
            assert math.isclose(r.own_fitted_tokens, min(r.goal_tokens, r.own_tokens * caps[s]), rel_tol=1e-6, abs_tol=1e-6), s
        used = rates.collect()
        assert all(0 <= r.rate <= caps.get(r.domain, 0) + 1e-9 and r.tokens > 0 for r in used)
        assert len(used) == sum(bool(t) for _, t, *_ in rows)
        own = sum(r.rate * r.tokens for r in used if r.domain == "c")
        assert math.isclose(own, rep["c"].own_fitted_tokens, rel_tol=1e-6)


def test_memberships_are_soft(spark):
    """Posteriors of all documents count: the expected tokens of domains differ from those by label, and sum up alike."""
    rates, report = mix(spark.createDataFrame(docs(), D), spark.createDataFrame(TARGETS, T), trust=0.5, unlabelled_uses=1)
    rep = report.collect()
    assert any(abs(r.expected_tokens - r.own_fitted_tokens) > 1 for r in rep)
    used = rates.filter("domain IS NULL").collect()
    assert used and all(0 <= r.rate <= 1 for r in used) and any(r.rate > 0 for r in used)


def test_short_by_next_to_nothing(spark):
    """The residual decides, however small it is, as it does where the capacity is just enough."""
    n = len(encode_text("some words here"))
    rows = [(i, "some words here", "a" if i < 30 else "b", 1, "") for i in range(100)]
    for share, short in ((0.9, False), (0.9 + 1e-6, True), (0.9 - 1e-6, False)):
        _, report = mix(spark.createDataFrame(rows, D), spark.createDataFrame([("a", share, 3), ("b", 1 - share, 9)], T))
        assert {r.source: r.short for r in report.collect()} == {"a": 30 * n * 3 < share * 100 * n, "b": False} and (30 * n * 3 < share * 100 * n) == short


def test_records_reach_the_shares(spark):
    import random

    r = random.Random(4)
    rows = [(i, "word " * r.randrange(1, 120), r.choice("aaaabbc"), 1, "") for i in range(3000)]
    targets = [("a", 0.35, 2), ("b", 0.45, 3), ("c", 0.2, 4)]
    fitted, report = mix(spark.createDataFrame(rows, D), spark.createDataFrame(targets, T))
    held = [x for x in records(fitted).collect()]
    size = {s: sum(x.tokens for x in held if x.domain == s) for s, *_ in targets}
    short, _, total = brute(rows, targets)
    for x in reached_shares(fitted, report).collect():
        assert x.mixed_tokens == size[x.source] and x.most_uses <= x.max_repeats and abs(x.actual_share - x.fitted_share) < 0.002
        assert x.short or abs(x.mixed_tokens - x.goal_tokens) <= 0.01 * x.goal_tokens
    assert not short and abs(sum(size.values()) - total) < 0.01 * total
    assert len({(x.doc_id, x.use) for x in held}) == len(held)
    parts = whole_uses(fitted, rounded=100).groupBy("domain").agg(F.sum(F.col("uses") * F.col("tokens")).alias("t")).collect()
    assert all(abs(p.t - size[p.domain]) < 0.02 * size[p.domain] for p in parts)


def test_empty(spark):
    rates, report = mix(spark.createDataFrame([], D), spark.createDataFrame(TARGETS, T))
    assert rates.count() == 0 and not any(r.short for r in report.collect()) and records(rates).count() == 0
    rates, report = mix(spark.createDataFrame(docs(), D), spark.createDataFrame([], T))
    assert report.count() == 0 and all(r.rate == 0 for r in rates.collect()) and reached_shares(rates, report).count() == 0


def test_whole_table(spark):
    from turnstone.llm.queries import p8_found

    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    targets = [tuple(r) for r in spark.read.parquet(f"{d}/mix_target.parquet").select("source", "target_share", "max_repeats").collect()]
    assert {r.source for r in p8_found(spark, d).collect()} == brute(rows, targets)[0]
