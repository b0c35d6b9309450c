import random

from turnstone.llm.quality import common_words, measure, readable, score

S = "doc_id bigint, text string, lang string, kind string, n_words int"
PROSE = "The river pilot describes the missing page. A quiet student opens an honest answer at the end of the day."


def cases():
    r = random.Random(1)
    item = lambda: " ".join(r.choice("small river page open answer quiet student".split()) for _ in range(r.randrange(1, 4)))
    prose = [PROSE, PROSE.replace(". ", ".\n"), "river pilot\ndescribes".replace("\n", " ") + " " + PROSE.lower().replace(".", ""), "[00:12] " + PROSE + "\n[00:30] " + PROSE, "Ann: " + PROSE + "\nBob: " + PROSE, PROSE + "\nMy neighbour keeps two plates in the cold room today.\nEvery volunteer follows a better road along the coast.\n- one\n- two", "Наша группа теряет маленькое окно под столом и потом весь отдел собирает путь.", "माली ठीक करता है सच्चा जवाब छुट्टी से पहले।", "The\tolder\tmap carries some warm bread when the light changes.\nThe panel carries what we saw."]
    lists = ["\n".join(f"{m} {item()}" for m in [b] * 9) for b in ("-", "*", "•", "☐")] + ["\n".join(f"{i + 1}. {item()}" for i in range(9)), "\n".join(item() for _ in range(9)), "\n".join(f"0{i}:15 {item()}" for i in range(9)), "#one #two #three\n#four #five", PROSE.split(".")[0] + ":\n" + "\n".join(f"({c}) {item()}" for c in "abcdefg")]
    tables = ["\n".join(sep.join(str(r.randrange(9999)) for _ in range(4)) for _ in range(8)) for sep in ("\t", "    ", ";", ",", " | ")] + ["<table>\n" + "\n".join("<tr><td>a</td><td>12</td></tr>" for _ in range(5)) + "\n</table>", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"]
    junk = ["-----\n====\n~~~~~", "x7k2 9qq1z 00a1b c3d4e " * 10, "hjk;lkwqrt fghj,dfgkl wrtpq;sdf " * 9 + "zzxcv", "".join(r.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(64)) + "\n" + "".join(r.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(64)), "subscribe to my channel " * 30, "again and again\n" * 20, "{}@#$%^&*()_+ " * 9]
    return [(t, k) for k, ts in (("prose", prose), ("list", lists), ("table", tables), ("junk", junk)) for t in ts]


def test_kinds(spark):
    rows = [(i, t, "en" if i % 2 else None, k, 1) for i, (t, k) in enumerate(cases())]
    rows += [(1000 + i, PROSE + f" Number {i} follows the longer route and the speaker keeps a bag of seeds.", "EN ", "prose", 1) for i in range(60)]
    rows += [(2000, None, "en", None, 1), (2001, " \n\t ", None, None, 1), (2002, "", "xx", None, 1), (2003, PROSE * 2000 + "different words at the end", "en", "junk", 1)]
    common = common_words(spark.createDataFrame([("en", "the"), ("en", "a"), ("en", "of"), (None, "x")], "lang string, word string"))
    df = spark.createDataFrame(rows, S)
    out = score(df, "doc_id", "text", "lang", common).collect()
    assert len(out) == len(rows)
    wrong = [(r.doc_id, r.kind, k, t[:60]) for r in sorted(out, key=lambda r: r.doc_id) for i, t, _, k, _ in rows if i == r.doc_id and r.kind != k]
    assert not wrong, wrong
    some = next(r for r in out if r.doc_id == 1000)
    assert 0 <= some.pct_n_words <= 1 and some.tails == [] and abs(some.z_readable_share) < 1


def prose_of(n):
    return [PROSE + f" Number {i} follows the longer route and the speaker keeps a bag of seeds." for i in range(n)]


def scored(spark, rows):
    df = spark.createDataFrame([(i, t, lang, None, 1) for i, (t, lang) in enumerate(rows)], S)
    return [r for r in sorted(score(df, "doc_id", "text", "lang", {}).collect(), key=lambda r: r.doc_id)]


def test_junk_is_found_whatever_its_share_of_a_language(spark):
    looped, unreadable = "subscribe to my channel " * 30, "hjk;lkwqrt fghj,dfgkl wrtpq;sdf " * 9
    rows = [(t, "en") for t in prose_of(200)] + [(looped, "en")] * 60 + [(unreadable, "en")] * 40
    rows += [(looped, "xx")] * 40 + [(unreadable, "yy")] * 40 + [(looped, "zz")] * 5 + [("The older map carries some warm bread when the light changes.", "few")] * 3
    out = scored(spark, rows)
    assert [r.kind for r in out] == ["prose"] * 200 + ["junk"] * 185 + ["prose"] * 3
    assert all(r.z_distinct_share < -5 for r in out[200:260])  # the scale does not grow with the copies


def test_documents_without_a_language_are_in_the_merged_sketch(spark):
    looped, unreadable = "subscribe to my channel " * 30, "hjk;lkwqrt fghj,dfgkl wrtpq;sdf " * 9
    texts = prose_of(60) + [looped] * 20 + [unreadable] * 10
    for label in (None, " ", "und"):
        out = scored(spark, [(t, label) for t in texts])
        assert [r.kind for r in out] == ["prose"] * 60 + ["junk"] * 30
        assert all(r.z_distinct_share is not None and r.pct_n_words > 0 for r in out) and out[60].z_distinct_share < -5
    # Long unlabelled documents are ordinary where most documents are long, whatever the labelled ones are.
    long = [" ".join(prose_of(40)[i:] + prose_of(i)) for i in range(40)]
    out = scored(spark, [(t, "en") for t in prose_of(10)] + [(t, None) for t in long])
    assert all("n_words" not in r.tails for r in out[10:])
    # So are those of labels that name no language.
    out = scored(spark, [(t, "en") for t in prose_of(42)] + [(t, f"label {i}") for i, t in enumerate(long)] * 2)
    assert all("n_words" not in r.tails for r in out[42:])


def test_every_language_has_its_own_sketch(spark):
    """However many languages there are, and in whatever spelling."""
    codes = [a + b for a in "abcdefghijklmnop" for b in "abcdefghijklmnopq"]
    rows = spark.createDataFrame([(c, (f" {c.upper()}-XX",)) for c in codes] + [("und", (x,)) for x in ("", "a", "12", "word too long", None)], "want string, s struct<l: string>")
    from turnstone.llm import quality

    got = rows.select("want", quality._language(rows["s.l"]).alias("got")).collect()
    assert len(codes) > 250 and all(r.want == r.got for r in got)


def test_scores_do_not_depend_on_the_partitions(spark):
    texts = [(t, k) for t, k in cases()] + [(t, "prose") for t in prose_of(80)]
    df = spark.createDataFrame([(i, t, ("en", "de", None)[i % 3], None, 1) for i, (t, _) in enumerate(texts)], S)
    once, again = (sorted(map(str, score(df.repartition(n), "doc_id", "text", "lang", {}).collect())) for n in (3, 17))
    assert once == again


def test_lists_and_tables_are_tails_of_their_lines(spark):
    out = scored(spark, [(t, "en" if i % 2 else "de") for i, (t, _) in enumerate(cases())] + [(t, "en") for t in prose_of(60)])
    for r in out:
        if r.kind in ("list", "table"):
            assert ("item_line_share" if r.kind == "list" else "row_line_share") in r.tails
        if r.kind == "prose":
            assert not {"readable_share", "distinct_share"} & set(r.tails)
    # So they are where they make up most of a language.
    kinds = [k for _, k in cases() if k in ("list", "table")]
    out = scored(spark, [(t, "en") for t, k in cases() if k in ("list", "table")] * 5)
    assert [r.kind for r in out] == kinds * 5


def test_sketches_merge_and_keep_the_quantiles(spark):
    from pyspark.sql import functions as F
    from turnstone.llm import quality

    r = random.Random(5)
    values = [r.lognormvariate(3, 1.5) for _ in range(999)] + [0.0, 1e6]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select(F.lit("en").alias("lang"), F.lit("n_words").alias("stat"), quality._bin(F.col("x")).alias("bin")).groupBy("lang", "stat", "bin").agg(F.count("*").alias("n"))
    q = quality.quantiles(rows).first()["n_words"]
    values.sort()
    assert len(q) == 101 and all(abs(a - b) <= 0.01 * b + 0.001 for a, b in zip(q, values[::10]))


def test_prose_without_spaces_or_with_marks_is_readable(spark):
    texts = ["今天天气很好，我们去公园散步，看见了很多花。然后大家一起回家吃饭，聊了很久，最后才慢慢睡觉，第二天又早早起床去上班。", "วันนี้อากาศดีมากเราไปเดินเล่นที่สวนสาธารณะกับเพื่อน", "ذهبَ الولدُ إلى المدرسةِ، ثمَّ عادَ إلى البيتِ."]
    out = scored(spark, [(t, "en") for t in prose_of(60)] + [(t, lang) for t, lang in zip(texts, ("zh", "th", "ar"))])
    assert [r.readable_share for r in out[60:]] == [1.0] * 3 and "junk" not in [r.kind for r in out]


def test_statistics_of_one_text():
    m = measure("The cat sat.\n\nA dog — ran!", {"the": ("en",), "a": ("en", "pt"), "sat": ("xx",)})
    assert (m["n_words"], m["n_lines"], m["punct_line_share"]) == (6, 2, 1.0) and abs(m["common_share"] - 2 / 6) < 1e-9
    assert abs(m["mean_word_length"] - 17 / 6) < 1e-9 or m["mean_word_length"] > 0
    assert measure(None, {}) is None and measure("\u200b \n", {}) is None
    assert [readable(x) for x in ("word", "12:30", "--", "a1b2", "Nachtschicht", "l'ultimo", "qwrtpsdf", "कमरे", "Ã©Ñ‚", "xxxxx")] == [True, None, None, False, True, True, False, True, False, False]


def test_empty(spark):
    assert score(spark.createDataFrame([], S), "doc_id", "text", "lang", {}).count() == 0
