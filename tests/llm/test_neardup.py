import itertools
import random
from pathlib import Path

import numpy as np
import pyarrow as pa

from turnstone.llm import neardup
from turnstone.llm.neardup import Likeness, all_pairs, choose_bands, groups, near_duplicates, ngram_hashes, plain_words
from turnstone.session import cut_lineage, shared_folder

S = "id bigint, text string, rep string, grams int"


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        i = r.randrange(len(words))
        words[i : i + 1] = r.choice([[], [words[i], "extra"], ["changed"]])
    return words


def corpus(seed=5):
    r = random.Random(seed)
    rows, i = [], 0
    for _ in range(40):
        base = [f"w{r.randrange(4000)}" for _ in range(60)]
        for k in range(r.randrange(1, 6)):
            rows.append((i, " ".join(edited(r, base, 3 * k)), "x", 1))
            i += 1
    rows += [(i + k, rows[0][1].upper() + "!!", "x", 1) for k in range(5)]
    return rows + rows[:10] + [(9000, None, "", 1), (9001, "", "", 1), (9002, "too short", "", 1), (None, "no id at all but many words", "", 1)]


def brute(rows, like):
    sets = {}
    for i, t, *_ in rows:
        w = plain_words(t)
        g = set(ngram_hashes(w, like.unit, like.n).tolist())
        if i is not None and t is not None and len(w) >= like.min_words and g:
            sets[i] = g
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= like.threshold * len(sets[a] | sets[b])}


def test_pairs_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, S)
    for like in (Likeness("word", 3, 0.5, min_words=20), Likeness("char", 3, 0.6), Likeness()):
        members, found = near_duplicates(df, "id", "text", like)
        got = [(r.id_a, r.id_b) for r in all_pairs(members, found).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, like)


def test_groups(spark):
    rows = corpus(6)
    like = Likeness("word", 3, 0.5, min_words=20)
    members, found = near_duplicates(spark.createDataFrame(rows, S), "id", "text", like)
    out = {r.id: r for r in groups(members, found).collect()}
    root = {i: i for i in out}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute(rows, like):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {i: r.group_id for i, r in out.items()} == {i: find(i) for i in out}
    assert out[0].class_id == 0 and all(out[i].class_id == 0 for i in out if plain_words(dict((r[0], r[1]) for r in rows)[i]) == plain_words(rows[0][1] + "!!"))


def test_empty_and_long(spark):
    members, found = near_duplicates(spark.createDataFrame([], S), "id", "text", Likeness())
    assert all_pairs(members, found).count() == 0 and groups(members, found).count() == 0
    long = " ".join(f"w{i}" for i in range(30_000))
    members, found = near_duplicates(spark.createDataFrame([(1, long, "", 1), (2, long + " end", "", 1)], S), "id", "text", Likeness())
    assert [(r.id_a, r.id_b) for r in all_pairs(members, found).collect()] == [(1, 2)]


def test_bands_reach_the_recall():
    for n in (100, 10_000, 10_000_000):
        met = {r: n**2 / 2 * 0.07**r for r in range(1, 9)}
        bands, rows = choose_bands(0.5, 0.998, n, met)
        assert 1 - (1 - 0.5**rows) ** bands >= 0.998
    few, many = ({r: n**2 / 2 * 0.07**r for r in range(1, 9)} for n in (100, 10_000_000))
    assert choose_bands(0.5, 0.998, 10_000_000, many)[1] > choose_bands(0.5, 0.998, 100, few)[1]
    # Rows have no upper end: where pairs meet often, bands get longer than what was measured.
    assert choose_bands(0.9, 0.99, 10**12, {r: 1e24 * 0.5**r for r in range(1, 9)})[1] > 8
    assert neardup.band_hashes(ngram_hashes(["a", "b", "c"], "word", 2), 4, 2).shape == (4,)


def test_meetings_are_counted(spark):
    df = spark.createDataFrame([(i, i % 3, [i % 3]) for i in range(9)], "rep long, n int, grams array<long>")
    assert neardup.meetings(df, 4) == {r: 9.0 for r in range(1, 5)}


def test_blocks_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rows = [("hot", i, i % 4) for i in range(60)] + [("small", i, 1) for i in range(3)] + [("one", 5, 1), (None, 1, 1), (None, 2, 1)]
    df = spark.createDataFrame(rows, "k string, i long, n int")
    got = [(r.a, r.b, r.a_n, r.b_n) for r in neardup.pairs_within(df.filter("k IS NOT NULL"), "k", "i", ["n"]).collect()]
    want = [(x[1], y[1], x[2], y[2]) for x, y in itertools.combinations(rows[:60], 2)] + [(x[1], y[1], 1, 1) for x, y in itertools.combinations(rows[60:63], 2)]
    assert sorted(got) == sorted(want)


def test_nothing_is_broadcast(spark):
    df = spark.createDataFrame(corpus(7), S)
    members, found = near_duplicates(df, "id", "text", Likeness("word", 3, 0.5, min_words=20))
    for out in (all_pairs(members, found), groups(members, found)):
        out.collect()
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold are found as often as the recall says."""
    r, rows, want = random.Random(11), [], 0
    for k in range(400):
        base = [f"b{k}x{j}" for j in range(90)]
        cut = 15 + r.randrange(2)
        rows += [(2 * k, " ".join(base), "", 1), (2 * k + 1, " ".join(base[:-cut] + [f"c{k}x{j}" for j in range(cut)]), "", 1)]
    like = Likeness("word", 3, 0.7, min_words=20)
    want = brute(rows, like)
    members, found = near_duplicates(spark.createDataFrame(rows, S), "id", "text", like)
    got = {(x.id_a, x.id_b) for x in all_pairs(members, found).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) > 100


def on_disk(spark):
    """Bytes of the shuffle files and of the shared folder."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    total = 0
    while files.hasNext():
        total += files.next().length()
    folder = Path(shared_folder(spark).removeprefix("file:"))
    return total + sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_disk_stays_below_four_times_the_texts(spark, tmp_path, monkeypatch):
    """n-gram sets are not written, and what a step moved is gone before the next one."""
    r, rows = random.Random(3), []
    for i in range(1500):
        base = [f"{r.choice('abcdefgh')}{r.randrange(900)}" for _ in range(160)]
        rows += [(3 * i + k, " ".join(edited(r, base, 4 * k)), "", 1) for k in range(2)]
    spark.createDataFrame(rows, S).coalesce(1).write.parquet(str(tmp_path / "texts"))
    size = sum(p.stat().st_size for p in (tmp_path / "texts").glob("*.parquet"))
    before, seen = on_disk(spark), []

    def cut(*args):
        out = cut_lineage(*args)
        seen.append(on_disk(spark) - before)
        return out

    monkeypatch.setattr(neardup, "cut_lineage", cut)
    members, found = near_duplicates(spark.read.parquet(str(tmp_path / "texts")), "id", "text", Likeness("word", 3, 0.5, min_words=20))
    seen.append(on_disk(spark) - before)
    found.collect()
    seen.append(on_disk(spark) - before)
    assert max(seen) < 4 * size and seen[-1] < 0.5 * size and found.count() > 1000


def test_bitmaps_never_promise_more_likeness_than_there_is():
    r, pairs = random.Random(4), []
    for n, more, apart in ((40, 0, 0), (40, 5, 9), (300, 40, 0), (5, 700, 3), (1, 0, 1), (900, 90, 1000)):
        for _ in range(20):
            x, y, z = (np.array([r.getrandbits(64) for _ in range(k)], np.uint64) for k in (n, more, apart))
            pairs.append((np.concatenate([x, y]), np.concatenate([x, z]), more + apart))
    columns = [pa.array([None, *(neardup.bitmap(p[k]) for p in pairs)], pa.binary())[1:] for k in (0, 1)]
    got = neardup.least_apart(*columns).tolist()
    assert all(g <= p[2] for g, p in zip(got, pairs)) and sum(got) > 0.3 * sum(p[2] for p in pairs)
    assert neardup.least_apart(pa.array([], pa.binary()), pa.array([], pa.binary())).tolist() == []


def test_different_texts_of_one_id_count_once(spark):
    """They made the id a representative twice, and its pairs came out twice."""
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base), "", 1), (1, " ".join([*base, "end"]), "", 1), (2, " ".join([*base, "other", "end"]), "", 1)]
    members, found = near_duplicates(spark.createDataFrame(rows, S), "id", "text", Likeness("word", 3, 0.5))
    assert [(r.id_a, r.id_b) for r in all_pairs(members, found).collect()] == [(1, 2)] and members.count() == 2


def test_bands_are_paired_in_slices(spark, monkeypatch):
    """Band rows lie on the disk one slice at a time; pairs are the same, and none comes twice."""
    rows, like = corpus(9), Likeness("word", 3, 0.5, min_words=20)
    monkeypatch.setattr(neardup, "SLICE", 10_000)
    monkeypatch.setattr(neardup, "SLICE_SHARE", 0)
    assert len(neardup.slices(97, 100, 0)) > 10 and neardup.slices(97, 100, 0)[-1][1] == 97
    members, found = near_duplicates(spark.createDataFrame(rows, S), "id", "text", like)
    got = [(r.id_a, r.id_b) for r in all_pairs(members, found).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, like)


def test_sets_of_many_texts_at_a_time(monkeypatch):
    monkeypatch.setattr(neardup, "STRETCH", 50)
    texts = ["a b c d a b c", "", "a", "é ü ß " * 30, "x y", "a b c d", "\U00020000 b c"]
    for like in (Likeness("word", 3), Likeness("char", 4)):
        got = [g.tolist() for g in neardup.sets_of([t.strip() for t in texts], like)]
        assert got == [ngram_hashes(t.split(), like.unit, like.n).tolist() for t in texts]
    sets = [ngram_hashes(t.split(), "word", 1) for t in texts if t]
    assert (neardup.band_slice(sets, 20, 3, 7, 12) == np.array([neardup.band_hashes(g, 20, 3)[7:12] for g in sets])).all()
