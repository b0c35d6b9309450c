import random

from turnstone.llm.nearest import nearest_in_time

L = "id string, who string, at double, seg bigint"
R = "seg bigint, who string, start double, id string"


def brute(left, right, tol):
    out = set()
    for i, w, t, _ in left:
        if w is None or t is None or t != t:
            continue
        c = [(abs(round(t * 1e6) - round(s * 1e6)), round(s * 1e6), g) for g, v, s, _ in right if v == w and s is not None and s == s]
        c = [x for x in c if x[0] <= round(tol * 1e6)]
        if c:
            out.add((i, min(c)[2]))
    return out


def run(spark, left, right, tol, **kw):
    out = nearest_in_time(spark.createDataFrame(left, L), spark.createDataFrame(right, R), "who", "id", "at", "seg", "start", tol, **kw)
    return {(r.id, r.seg) for r in out.collect()}


def test_against_brute_force(spark):
    r = random.Random(3)
    left = [(f"f{i}", r.choice("aab"), round(r.uniform(0, 3000), 3), 0) for i in range(600)]
    right = [(i, r.choice("aab"), round(r.uniform(0, 3000), 2), "x") for i in range(900)]
    for groups, bucket in ((None, 600.0), (3, 20.0)):
        assert run(spark, left, right, 1.5, groups=groups, bucket_seconds=bucket) == brute(left, right, 1.5)


def test_ties_edges_and_nulls(spark):
    left = [("tie", "a", 10.0, 1), ("edge", "a", 601.5, 1), ("far", "a", 900.0, 1), ("nul", "a", None, 1), ("nan", "a", float("nan"), 1), ("who", None, 10.0, 1), ("neg", "a", -0.5, 1), ("one", "b", 5.0, 1)]
    right = [(7, "a", 9.0, ""), (8, "a", 11.0, ""), (3, "a", 9.0, ""), (9, "a", 600.0, ""), (10, "a", None, ""), (11, None, 10.0, ""), (12, "a", float("inf"), ""), (13, "a", -1.0, "")]
    assert run(spark, left, right, 1.5) == {("tie", 3), ("edge", 9), ("neg", 13)} == brute(left, right[:5] + right[7:], 1.5)


def test_hot_entity_and_copies(spark):
    left = [(f"f{i}", "hot", i * 0.5, 0) for i in range(3000)]
    right = [(i % 500, "hot", (i % 500) * 3.0, "") for i in range(3000)]
    assert run(spark, left, right, 1.0, bucket_seconds=30.0) == brute(left, right[:500], 1.0)


def test_empty(spark):
    assert run(spark, [], [], 1.0) == set() and run(spark, [("a", "a", 1.0, 1)], [], 1.0) == set() and run(spark, [], [(1, "a", 1.0, "")], 1.0) == set()


def test_repeated_left_ids_do_not_depend_on_groups(spark):
    left = [("same", "a", 10.0, 1), ("same", "a", 10.0, 2), ("same", "a", 4000.0, 1), ("same", "b", 10.0, 1)]
    right = [(1, "a", 10.5, ""), (2, "a", 4000.5, ""), (3, "b", 9.5, ""), (1, "a", 10.5, "copy")]
    for groups in (1, 97):
        out = nearest_in_time(spark.createDataFrame(left, L), spark.createDataFrame(right, R), "who", "id", "at", "seg", "start", 1.0, groups=groups)
        assert sorted(r.seg for r in out.collect()) == [1, 2, 3]
