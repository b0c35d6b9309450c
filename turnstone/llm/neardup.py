"""Near-duplicate records with small edits: MinHash banding, then verification on full n-gram sets.

Exact copies (same words) are folded into one class before anything else, so copies cost one row, however many there
are. Band and row counts follow from the wanted recall at the threshold and from how many pairs of the collection are
measured to meet in a band of so many rows. Candidates are pairs of classes that share a band. A small bitmap of each
n-gram set proves most of the wrong ones too far apart; the others are verified by the exact Jaccard coefficient of
their n-gram sets. These sets are several times as large as the texts, so they are never written or moved: the words
are, and each step makes the sets anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from turnstone.session import brief_shuffles, bytes_of, cut_lineage, release, spread

_WORDS = regex.compile(r"[\p{L}\p{N}]+")
#: What a pair that meets in a band costs, in band rows.
PAIR_COST = 8.0
#: Rows of a band whose meetings are measured.
MEASURED = 8
#: Rows of one key that are paired in one block; larger groups are cut into blocks and the blocks are paired.
BLOCK = 2_000
#: Band rows on the disk at a time: so many bytes, or so many times the table of words if that is more.
SLICE, SLICE_SHARE = 64 << 20, 2
#: What a band row takes in a shuffle.
BAND_BYTES = 14
#: Characters whose n-grams are hashed at a time.
STRETCH = 1 << 18


@dataclass(frozen=True)
class Likeness:
    """What makes two texts alike: ``n`` successive ``unit``s ('word' or 'char'), shared to ``threshold`` (Jaccard)."""

    unit: str = "word"
    n: int = 5
    threshold: float = 0.8
    #: Texts with fewer words take no part.
    min_words: int = 1
    recall: float = 0.998


def plain_words(text: str | None) -> list[str]:
    """Lower-case words; what is neither letter nor digit separates."""
    return _WORDS.findall((text or "").lower())


@lru_cache(maxsize=200_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def ngram_hashes(words: list[str], unit: str, n: int) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of ``n`` words, or of ``n`` characters of the words joined by spaces."""
    if unit == "word":
        units = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    else:
        units = np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.unique(_run_hashes(units, n))


def sets_of(texts: list[str], like: Likeness) -> Iterator[np.ndarray]:
    """``ngram_hashes`` of texts of ``plain_words``, of many texts at a time."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > STRETCH:
            yield from _sets_at_once(texts[first:i], like)
            first, size = i, 0
        size += len(t)
    yield from _sets_at_once(texts[first:], like)


def _sets_at_once(texts: list[str], like: Likeness) -> Iterator[np.ndarray]:
    n = like.n
    if like.unit == "word":
        parts = [t.split(" ") for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(texts))
        units = np.fromiter(map(_word_hash, chain.from_iterable(parts)), np.uint64, counts.sum())
    else:
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        units = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = _run_hashes(units, n)
    start = np.cumsum(counts) - counts
    # Runs that reach from one text into the next are none of either.
    for a, b in zip(start.tolist(), (start + np.maximum(counts - n + 1, 0)).tolist()):
        run = h[a:b]
        run.sort()
        yield run[np.concatenate([run[:1] == run[:1], run[1:] != run[:-1]])]


def _run_hashes(units: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` units."""
    h = np.zeros(max(len(units) - n + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n if len(h) else 0):
            h = (h ^ units[i : len(units) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def choose_bands(threshold: float, recall: float, records: int, meetings: dict[int, float]) -> tuple[int, int]:
    """(bands, rows): of all that find a pair at the threshold with at least ``recall``, the cheapest.

    ``meetings``: for 1, 2, 3 ... rows, how many pairs of the collection meet in one band of so many rows, as measured
    over all records. Beyond the last number it falls as it did before, so the rows have no upper end. Cost counts the
    band rows to shuffle and the pairs that meet in a band.
    """
    best = None
    known = max(meetings)
    fall = min(meetings[known] / meetings[known - 1], 0.9) if known - 1 in meetings and meetings[known - 1] else 0.5
    rows = 0
    while True:
        rows += 1
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        pairs = meetings[rows] if rows in meetings else meetings[known] * fall ** (rows - known)
        cost = bands * (records + PAIR_COST * pairs)
        if best is None or cost < best[0]:
            best = (cost, bands, rows)
        elif bands * records > best[0]:
            return best[1], best[2]


@lru_cache(maxsize=8)
def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, k, dtype=np.uint32)


def _minima(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of the hashes with coefficients ``a, b`` over the n-grams, 32 bits each, which processors multiply many at a time."""
    short = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(short), 2048):
        x = short[None, i : i + 2048] * a[:, None]
        x += b[:, None]
        np.minimum(low, x.min(axis=1), out=low)
    return low


def _signatures(sets: Iterable[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of each set, one row for each."""
    return np.stack([np.empty(len(a), np.uint32), *(_minima(g, a, b) for g in sets)])[1:].astype(np.uint64)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band of the MinHash signature; each depends on the band's number too."""
    return band_slice([grams], bands, rows, 0, bands)[0]


def band_slice(sets: Iterable[np.ndarray], bands: int, rows: int, first: int, end: int) -> np.ndarray:
    """For each set its ``band_hashes`` from ``first`` to before ``end``."""
    a, b = (c[first * rows : end * rows] for c in _coefficients(bands * rows))
    signs = _signatures(sets, a, b).reshape(-1, end - first, rows)
    with np.errstate(over="ignore"):
        h = np.arange(first + 1, end + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB) + np.zeros((len(signs), 1), np.uint64)
        for i in range(rows):
            h = (h ^ signs[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(30)
    return h.view(np.int64)


def nested_hashes(sets: Iterable[np.ndarray], most: int) -> np.ndarray:
    """For each set the hashes of a band of one row, of its first two rows, and so on up to ``most`` rows."""
    signs = _signatures(sets, *_coefficients(most))
    out, h = np.empty(signs.shape, np.uint64), np.ones(len(signs), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(most):
            h = (h ^ signs[:, i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(30)
            out[:, i] = h
    return out.view(np.int64)


def _lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow array of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def bitmap(grams: np.ndarray) -> bytes:
    """For each of 2 to 4 places an n-gram (a power of two, 64 at least), whether an odd number of n-grams falls there."""
    places = 1 << max(6, (2 * len(grams) - 1).bit_length())
    at = (grams & np.uint64(places - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(np.uint8)).tobytes()


def least_apart(a: pa.Array, b: pa.Array) -> np.ndarray:
    """How many n-grams at least only one set of each pair has, by their bitmaps.

    An n-gram of one set only changes one place of one bitmap, so at least as many differ as places do. The larger
    bitmap is folded to the size of the smaller one.
    """
    (x, at), (y, bt) = _bytes_of(a), _bytes_of(b)
    sizes, out = np.stack([np.diff(at), np.diff(bt)], axis=1), np.zeros(len(a), np.int64)
    for m, n in np.unique(sizes, axis=0):
        rows = np.flatnonzero((sizes == (m, n)).all(axis=1))
        step = max(1, (4 << 20) // int(m + n))
        for i in range(0, len(rows), step):
            k = rows[i : i + step]
            u, v = x[at[k][:, None] + np.arange(m)], y[bt[k][:, None] + np.arange(n)]
            u, v = (np.bitwise_xor.reduce(w.reshape(len(k), -1, min(m, n)), axis=1) for w in (u, v))
            out[k] = np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64)
    return out


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow array, and where each value starts and the last one ends."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), at


def _keyed(like: Likeness):
    n, unit, least = like.n, like.unit, like.min_words

    @F.arrow_udf(T.StructType().add("key", T.BinaryType()).add("words", T.StringType()))
    def keyed(texts: pa.Array) -> pa.Array:
        keys, kept = [], []
        for t in texts.to_pylist():
            w = plain_words(t)
            whole = " ".join(w)
            enough = len(w) >= least and (len(w) if unit == "word" else len(whole)) >= n
            keys.append(xxhash.xxh128_digest(whole) if enough else None)
            kept.append(whole if enough else None)
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(kept, pa.string())], ["key", "words"])

    # Not taken for deterministic, so that the planner does not evaluate it again for filters on its result.
    return keyed.asNondeterministic()


def _described(like: Likeness, most: int):
    """Size and bitmap of the n-gram set, and its nested hashes."""

    @F.arrow_udf(T.StructType().add("n", T.IntegerType()).add("bits", T.BinaryType()).add("s", T.ArrayType(T.LongType())))
    def described(words: pa.Array) -> pa.Array:
        sets = list(sets_of(words.to_pylist(), like))
        columns = [pa.array([len(g) for g in sets], pa.int32()), pa.array([bitmap(g) for g in sets], pa.binary()), _lists(nested_hashes(sets, most))]
        return pa.StructArray.from_arrays(columns, ["n", "bits", "s"])

    return described.asNondeterministic()


def classes(df: DataFrame, record_id: str, text: str, like: Likeness, scratch: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(``id, rep``, ``rep, words, n, bits, s``): ``rep`` is the smallest id with the same words; ``n``, ``bits`` and
    ``s`` are size, bitmap and nested hashes of its n-gram set.

    Records with a null id or text, with too few words, or too short for one n-gram are left out; repeated rows of an
    id count once, and of different texts of an id the one with the smallest key counts. Copies are reduced in the map
    tasks; the join that gives every record its class is a merge join, of which Spark splits hot keys.
    """
    rows = df.select(F.col(f"`{record_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).dropna()
    # Read into words once and written: representatives and memberships both start here.
    once: list[str] = []
    keyed = cut_lineage(spread(rows).select("id", _keyed(like)("text").alias("k")).select("id", "k.*").filter("key IS NOT NULL"), once)
    ids = keyed.groupBy("id").agg(F.min("key").alias("key"))
    reps = ids.groupBy("key").agg(F.min("id").alias("rep"))
    members = cut_lineage(ids.join(reps.hint("merge"), "key").select("id", "rep", "key"))
    words = keyed.groupBy("key").agg(F.first("words").alias("words"))  # rows of a key have the same words
    sets = words.join(members.filter("id = rep").select("key", "rep").hint("merge"), "key")
    sets = cut_lineage(sets.select("rep", "words", _described(like, MEASURED)("words").alias("d")).select("rep", "words", "d.*"), scratch)
    release(df.sparkSession, once)
    return members.select("id", "rep"), sets


def meetings(sets: DataFrame, most: int = MEASURED) -> dict[int, float]:
    """For 1 .. ``most`` rows, how many pairs of records meet in one band of so many rows."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sign(grams: pa.Array) -> pa.Array:
        return _lists(nested_hashes(_sets_of(grams), most))

    return counted(sets.select(sign.asNondeterministic()("grams").alias("s")), most)


def counted(signed: DataFrame, most: int = MEASURED) -> dict[int, float]:
    """``meetings`` of records whose nested hashes are ``s``."""
    met = signed.select(F.posexplode("s").alias("r", "h")).groupBy("r", "h").count().filter("count > 1")
    found = met.groupBy("r").agg(F.sum(F.expr("count * (count - 1D) / 2")).alias("pairs")).collect()  # at most one row for each number of rows
    return {r: 0.0 for r in range(1, most + 1)} | {x["r"] + 1: float(x["pairs"]) for x in found}


def _sets_of(grams: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow array as slices of one numpy array."""
    flat, at = grams.values.to_numpy(), grams.offsets.to_numpy()
    return [flat[a:b].view(np.uint64) for a, b in zip(at, at[1:])]


def pairs_within(rows: DataFrame, key: str, item: str, carry: list[str], keep: str = "true", scratch: list[str] | None = None) -> DataFrame:
    """``a, b`` and ``carry`` of both (``a_x, b_x``): all pairs (a < b) of different ``item``s of one ``key``.

    Keys that stand alone go before anything is paired. A key of many rows is cut into blocks, and every two blocks
    meet in another task, so a hot key is shared among as many tasks as its pairs need. ``keep`` is a condition on
    a pair's columns.
    """
    rows = rows.select(F.col(key).alias("h"), F.col(item).alias("x"), *carry)
    rows = rows.withColumn("c", F.count("*").over(Window.partitionBy("h"))).filter("c > 1")
    rows = rows.withColumn("k", F.ceil(F.col("c") / BLOCK).cast("int"))
    # Written once, a small part of the rows: both sides of the join start here.
    rows = cut_lineage(rows.withColumn("at", F.pmod(F.xxhash64("x"), "k").cast("int")).drop("c"), scratch)
    side = lambda name: [F.col("x").alias(f"{name}x"), *[F.col(c).alias(f"{name}_{c}") for c in carry]]
    left = rows.select("h", F.col("at").alias("i"), F.explode(F.sequence("at", F.col("k") - 1)).alias("j"), *side("p"))
    right = rows.select("h", F.explode(F.sequence(F.lit(0), "at")).alias("i"), F.col("at").alias("j"), *side("q"))
    both = left.hint("merge").join(right, ["h", "i", "j"]).filter("px <> qx AND (i < j OR px < qx)")
    first = F.col("px") < F.col("qx")
    columns = [F.least("px", "qx").alias("a"), F.greatest("px", "qx").alias("b")]
    for c in carry:
        columns += [F.when(first, F.col(f"p_{c}")).otherwise(F.col(f"q_{c}")).alias(f"a_{c}"), F.when(first, F.col(f"q_{c}")).otherwise(F.col(f"p_{c}")).alias(f"b_{c}")]
    return both.select(*columns).filter(keep)


def slices(bands: int, records: int, size: int) -> list[tuple[int, int]]:
    """The bands in slices as even as can be, (first, end) each: their rows lie on the disk one slice at a time.

    The number of bands grows with the number of records, so band rows outgrow any multiple of the texts. ``size``:
    bytes of the table of words.
    """
    n = min(bands, math.ceil(bands * records * BAND_BYTES / max(SLICE, SLICE_SHARE * size)))
    return [(bands * i // n, bands * (i + 1) // n) for i in range(n)]


def links(sets: DataFrame, like: Likeness) -> DataFrame:
    """``a, b, shared, either``: pairs of representatives (a < b) whose n-gram sets reach the threshold.

    No side of a join is broadcast, whatever the planner takes its size for. Pairs whose sets are too unequal in size
    or, by their bitmaps, too far apart to reach the threshold go before their words are fetched. Each step is written,
    and what only an earlier one reads is deleted; bands are paired slice by slice.
    """
    spark, met, near = sets.sparkSession, [], []
    records = max(sets.count(), 2)
    bands, rows = choose_bands(like.threshold, like.recall, records, counted(sets.select("s")))

    def signed(first: int, end: int):
        @F.arrow_udf(T.ArrayType(T.LongType()))
        def sign(words: pa.Array) -> pa.Array:
            return _lists(band_slice(sets_of(words.to_pylist(), like), bands, rows, first, end))

        return sign.asNondeterministic()("words")

    @F.arrow_udf(T.LongType())
    def apart(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(least_apart(a, b), pa.int64())

    @F.arrow_udf(T.LongType())
    def shared(a: pa.Array, b: pa.Array) -> pa.Array:
        both = zip(sets_of(a.to_pylist(), like), sets_of(b.to_pylist(), like))
        return pa.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in both], pa.int64())

    def ends(pairs: DataFrame, column: str) -> DataFrame:
        sides = (sets.select(F.col("rep").alias(x), F.col(column).alias(f"{x}_{column}")).hint("merge") for x in ("a", "b"))
        return pairs.join(next(sides), "a").join(next(sides), "b")

    alike = f"least(a_n, b_n) >= greatest(a_n, b_n) * {like.threshold!r}D"
    total = F.col("a_n") + F.col("b_n")
    close = []
    for first, end in slices(bands, records, bytes_of(sets)):
        band = sets.select("rep", "n", signed(first, end).alias("s")).select("rep", "n", F.explode("s").alias("h"))
        pairs = cut_lineage(pairs_within(band, "h", "rep", ["n"], alike, met).distinct(), met)
        most = ends(pairs, "bits").withColumn("most", (total - apart.asNondeterministic()("a_bits", "b_bits")) / 2)
        close.append(cut_lineage(most.filter(F.col("most") >= (total - F.col("most")) * F.lit(like.threshold)).select("a", "b", "a_n", "b_n"), near))
        release(spark, met)
    close = close[0] if len(close) == 1 else reduce(DataFrame.unionByName, close).distinct()
    both = ends(close, "words").select("a", "b", total.alias("total"), shared.asNondeterministic()("a_words", "b_words").alias("shared"))
    both = both.select("a", "b", "shared", (F.col("total") - F.col("shared")).alias("either"))
    found = cut_lineage(both.filter(F.col("shared") >= F.col("either") * F.lit(like.threshold)))
    release(spark, near)
    return found


def near_duplicates(df: DataFrame, record_id: str, text: str, like: Likeness) -> tuple[DataFrame, DataFrame]:
    """(members, links): each record's class, and the verified links between representatives of classes."""
    scratch: list[str] = []
    with brief_shuffles(df.sparkSession):
        members, sets = classes(df, record_id, text, like, scratch)
        found = links(sets, like)
    release(df.sparkSession, scratch)
    return members, found


def all_pairs(members: DataFrame, found: DataFrame) -> DataFrame:
    """``id_a, id_b``: every pair of different records that are copies or linked, smaller id first.

    A class of m copies has m * (m - 1) / 2 pairs, which are made block by block; where they are not wanted, the links
    and the memberships of ``near_duplicates`` say the same in m rows.
    """
    copies = pairs_within(members, "rep", "id", []).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    a = members.select(F.col("rep").alias("a"), F.col("id").alias("x")).hint("merge")
    b = members.select(F.col("rep").alias("b"), F.col("id").alias("y")).hint("merge")
    linked = found.select("a", "b").join(a, "a").join(b, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return copies.unionByName(linked)


def groups(members: DataFrame, found: DataFrame) -> DataFrame:
    """``id, class_id, n_links, group_id``: one row per record; groups are what links and copies connect.

    Smallest ids spread along the links and are followed to their own smallest id in every round, so the number of
    rounds grows with the logarithm of a group's diameter. Nothing but a count of changes reaches the driver.
    """
    found = cut_lineage(found.select("a", "b"))
    edges = cut_lineage(found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut_lineage(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")))
    while True:
        near = edges.join(label.select(F.col("a").alias("b"), "l").hint("merge"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(near.hint("merge"), "a").select("a", F.least("l", "m").alias("n"), F.col("l").alias("was"))
        step = cut_lineage(step)
        jump = step.join(step.select(F.col("a").alias("n"), F.col("n").alias("j")).hint("merge"), "n", "left")
        new = cut_lineage(jump.select("a", F.least("n", F.coalesce("j", "n")).alias("l"), "was"))
        changed = new.filter("l <> was").limit(1).count()
        label = new.select("a", "l")
        if not changed:
            break
    counts = edges.groupBy("a").agg(F.count("*").alias("n_links"))
    info = counts.join(label.hint("merge"), "a")
    out = members.join(info.hint("merge"), members["rep"] == info["a"], "left")
    return out.select("id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("l", "rep").alias("group_id"))
