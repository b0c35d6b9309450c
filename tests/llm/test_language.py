import random

from turnstone.llm import language as L

WORDS = {
    "en": "the old captain walks along the river and the children watch the small boats while their mother reads a good book under that tree".split(),
    "de": "der alte kapitän geht am fluss entlang und die kinder schauen den kleinen booten zu während ihre mutter ein gutes buch unter dem baum liest".split(),
    "fr": "le vieux capitaine marche le long de la rivière et les enfants regardent les petits bateaux pendant que leur mère lit un bon livre".split(),
    "ru": "старый капитан идёт вдоль реки и дети смотрят на маленькие лодки пока их мать читает хорошую книгу под тем деревом".split(),
}
S = "id bigint, text string, d string, language string"


def talk(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def model(noise=0.1):
    r = random.Random(2)
    langs = list(WORDS)
    rows = [(talk(r, lang, 40).split(), lang if r.random() > noise else r.choice(langs)) for lang in langs for _ in range(40)]
    return L.fit(rows, langs)


def test_codes():
    named = {"en": "en", "EN-us": "en", " eng ": "en", "en_AU": "en", "ger": "de", "Deutsch": None, "Hindi": "hi", "por-BR": "pt", "ja": "ja", "und": None, "": None, None: None, "unknown": None, "auto": None, "n/a": None, "-": None}
    assert {k: L.language_of_code(k) for k in named} == named


def test_codewords_are_apart():
    c = L.codewords(10)
    d = (c[:, None, :] != c[None, :, :]).sum(axis=2)
    assert d[~__import__("numpy").eye(10, dtype=bool)].min() >= 5 and abs(c.sum(axis=0)).max() <= 1


def test_held_out_accuracy_with_wrong_labels():
    r, m = random.Random(9), model()
    texts = [(talk(r, lang, 15), lang) for lang in WORDS for _ in range(50)]
    assert sum(L.describe(t, m)["language"] == lang for t, lang in texts) >= 0.99 * len(texts)


def test_stretches_and_quotations():
    r, m = random.Random(4), model()
    mixed = L.describe(talk(r, "en", 60) + " [Music] " + talk(r, "de", 30) + " " + talk(r, "en", 40), m)
    assert mixed["language"] == "en" and [s["language"] for s in mixed["segments"]] == ["en", "de", "en"]
    assert abs(mixed["segments"][1]["n_words"] - 30) <= 2 and 0 < mixed["confidence"] <= 1
    quoted = L.describe(talk(r, "fr", 60) + " " + talk(r, "ru", 6) + " " + talk(r, "fr", 60), m)
    assert [s["language"] for s in quoted["segments"]] == ["fr"]
    assert L.describe(None, m) is None and L.describe(" [Music] ♪ 00:01 ", m) is None
    assert L.describe("12345 678", m)["ambiguous"] is True


def test_cheapest_path_against_all_paths():
    import itertools

    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(200):
        loss = r.uniform(0, 3, (7, 3)).astype(np.float32)
        cost = lambda p: sum(loss[i, s] for i, s in enumerate(p)) + 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = min(cost(p) for p in itertools.product(range(3), repeat=7))
        mine = [s for s, a, b in L.path(loss, 2.0) for _ in range(b - a)]
        assert abs(cost(mine) - best) < 1e-4


def test_table(spark):
    r = random.Random(8)
    rows = [(1, talk(r, "de", 30), "x", "en"), (1, talk(r, "de", 30), "x", "en"), (2, None, "x", ""), (3, "", "", ""), (4, talk(r, "ru", 30_000), "", ""), (None, talk(r, "fr", 20), "", "")]
    df = spark.createDataFrame(rows, S)
    out = {(x.id, x.d.language if x.d else None) for x in L.detect(df, "id", "text", model()).collect()}
    assert out == {(1, "de"), (2, None), (3, None), (4, "ru"), (None, "fr")}
    assert L.detect(df.limit(0), "id", "text", model()).count() == 0


def test_fit_on_nothing(spark):
    empty = spark.createDataFrame([], "text string, code string")
    m = L.fit_on(empty, "text", "code")
    assert L.describe("some words here", m)["ambiguous"] is True


def test_whole_table(spark):
    """Kinds agree with the declared codes for most rows of the data, whose codes are mostly right."""
    from turnstone.llm.queries import p5_found

    rows = p5_found(spark, "/root/testdata/sf0.001").collect()
    assert rows and {r.kind for r in rows} <= {"missing", "wrong", "mixed"} and all(r.language in L.CODES for r in rows)


def test_labels_inside_the_jvm(spark):
    codes = ["en", "EN-us", " eng ", "en_AU", "ger", "Deutsch", "Hindi", "por-BR", "ja", "und", "", None, "unknown", "n/a", "-", "\u00a0de\u00a0"]
    df = spark.createDataFrame([(c,) for c in codes], "c string").select("c", L._named("c").alias("n"))
    assert [r.n for r in df.collect()] == [x if (x := L.language_of_code(c)) in L.CODES else None for c in codes]


def test_sample_holds_copies_once(spark, monkeypatch):
    r, seen = random.Random(6), []
    monkeypatch.setattr(L, "fit", lambda samples, langs, words: seen.append((samples, words)))
    rows = [("the same text again and again", "en")] * 500 + [(talk(r, "de", 20), f"de-{i}") for i in range(40)] + [(None, "en"), ("x", "zz")]
    seeds = spark.createDataFrame([("en", "the"), ("en", "the"), (None, "x")], "lang string, word string")
    L.fit_on(spark.createDataFrame(rows, "t string, c string"), "t", "c", seeds, rows=1000)
    samples, words = seen[0]
    assert len(samples) == 41 and words == {"en": ["the"]}
    import pytest

    with pytest.raises(ValueError):
        L.fit_on(spark.createDataFrame(rows, "t string, c string"), "t", "c", seeds, most_seeds=0)
