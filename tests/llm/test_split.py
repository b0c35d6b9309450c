import random

from turnstone.llm.split import _spans, split_items, split_text

S = "chunk_id string, text string, start_timestamp double, end_timestamp double, piece int, cut string"


def check(text, limit=150, overlap=20):
    out = split_text(text, limit, overlap)
    words = text.split()
    assert out["n_words"] == len(words)
    at = 0
    for p in out["pieces"]:
        new = p["n_words"] - p["overlap"]
        assert p["text"].split() == words[at - p["overlap"] : at + new] and p["n_words"] <= limit and new > 0
        assert p["overlap"] == min(overlap, at)
        at += new
    assert at == len(words)
    return out


def brute_cut(text, limit=150):
    run = longest = 0
    spans = _spans(text)
    for i, (a, b) in enumerate(spans):
        run += 1
        longest = max(longest, run)
        gap = text[b : spans[i + 1][0]] if i + 1 < len(spans) else ""
        if text[b - 1] in ".!?…।" or any(c in gap for c in "\n\r\x0b\x0c\x85\u2028\u2029"):
            run = 0
    return "none" if len(spans) <= limit else "forced" if longest > limit else "natural"


def test_random_texts():
    r = random.Random(1)
    for _ in range(150):
        n = r.randrange(0, 700)
        ends = r.choice([0.0, 0.01, 0.1])
        text = "".join(f"w{i}" + (r.choice(".!?…।") if r.random() < ends else "") + r.choice([" ", " ", " ", "  ", "\t", "　", "\n" if r.random() < 0.05 else " "]) for i in range(n))
        out = check(text)
        assert out["cut"] == brute_cut(text)


def test_natural_ends_where_possible():
    text = " ".join(" ".join(f"w{i}" for i in range(12)) + "." for _ in range(60))
    out = check(text)
    assert out["cut"] == "natural" and all(p["text"].endswith(".") and not p["forced"] for p in out["pieces"])
    assert check("word " * 151)["cut"] == "forced" and check("word " * 150)["cut"] == "none"
    assert check("x" * 100_000 + " " + "y " * 20_000)["cut"] == "forced"


def test_table(spark):
    text = " ".join(f"w{i}." for i in range(300))
    rows = [("a", text, 10.0, 40.0, 1, "x"), ("a", text, 10.0, 40.0, 1, "x"), ("b", text, None, 40.0, 1, "x"), ("c", text, 40.0, 10.0, 1, "x"), ("d", text, 5.0, 5.0, 1, "x"), ("e", None, 1.0, 2.0, 1, "x"), ("f", "  \n", 1.0, 2.0, 1, "x"), ("g", "short", 1.0, 2.0, 1, "x"), ("h", text, float("nan"), 2.0, 1, "x")]
    out = split_items(spark.createDataFrame(rows, S)).orderBy("chunk_id", "piece").collect()
    by = {}
    for r in out:
        by.setdefault(r.chunk_id, []).append(r)
    assert set(by) == set("abcdgh") and len(by["a"]) == len(by["b"])
    a = by["a"]
    assert a[0].start_timestamp == 10.0 and a[-1].end_timestamp == 40.0 and all(x.end_timestamp == y.start_timestamp for x, y in zip(a, a[1:]))
    assert all(r.start_timestamp is None for k in "bch" for r in by[k]) and all(r.start_timestamp == r.end_timestamp == 5.0 for r in by["d"])
    assert split_items(spark.createDataFrame([], S)).count() == 0


def test_rows_without_an_id_are_not_folded(spark):
    long = " ".join(f"w{i}." for i in range(200))
    rows = [(None, "one two.", 0.0, 1.0, 0, ""), (None, "one two.", 0.0, 1.0, 1, ""), (None, "three.", 0.0, 1.0, 0, ""), (None, "three.", 5.0, 6.0, 0, ""), (None, long, None, float("nan"), 0, ""), (None, None, 0.0, 1.0, 0, ""), ("a", "four.", 0.0, 1.0, 0, ""), ("a", "four.", 0.0, 1.0, 2, "")]
    df = spark.createDataFrame(rows, S)
    assert sorted(r.text for r in split_items(df).filter("piece = 0").collect() if r.n_words < 9) == ["four.", "one two.", "three.", "three."]
    assert split_items(df).filter("piece = 0 AND n_words = 200").count() == 1
    assert split_items(df, content=["text"]).filter("piece = 0").count() == 4


def test_rows_that_differ_give_one_defined_result(spark):
    rows = [("a", "one two.", 0.0, 1.0, 0, ""), ("a", "three four.", 5.0, 6.0, 0, ""), ("a", None, 5.0, 6.0, 0, "")]
    for order in (rows, rows[::-1]):
        assert [(r.text, r.start_timestamp) for r in split_items(spark.createDataFrame(order, S).repartition(3)).collect()] == [("three four.", 5.0)]
