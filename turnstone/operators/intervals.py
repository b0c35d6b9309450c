"""Merging overlapping time intervals per entity and listing the gaps between them.

The aggregate's state is a sorted list of disjoint intervals of one (entity, time bucket). Lists are built batch by
batch inside the map tasks and merged pairwise, like to like, so a hot entity or a third of all rows being copies
shrinks before the shuffle; after it the partial lists of a bucket are merged pairwise again in the same kind of tree.
Merging two lists is linear: both are sorted, and the sort that joins them finds two runs. Buckets are stitched together
by two sweeps over a few rows per bucket. At most ``bucket_ms / 2`` disjoint intervals fit into one bucket, so no list
is unbounded, whatever share of the rows one entity has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone.session import cut_lineage

BUCKET_MS = 3_600_000
#: Intervals that a map task holds before it hands its lists on.
HELD = 500_000


class Lists:
    """Sorted disjoint intervals by group: ``g`` (group number), ``s``, ``e``, ordered by group and start."""

    def __init__(self, g: np.ndarray, s: np.ndarray, e: np.ndarray):
        self.g, self.s, self.e = g, s, e

    @staticmethod
    def of(g: np.ndarray, s: np.ndarray, e: np.ndarray) -> Lists:
        """The lists of intervals in any order; touching intervals are joined."""
        if not len(g):
            return Lists(g, s, e)
        order = np.lexsort((s, g))  # stable and made of merges: two sorted runs are merged in linear time
        g, s, e = g[order], s[order], e[order]
        first = np.ones(len(g), bool)
        first[1:] = g[1:] != g[:-1]
        high = pd.Series(e).groupby(np.cumsum(first)).cummax().to_numpy()
        opens = first
        opens[1:] |= s[1:] > high[:-1]
        at = np.flatnonzero(opens)
        return Lists(g[at], s[at], high[np.append(at[1:], len(g)) - 1])

    def merge(self, other: Lists) -> Lists:
        return Lists.of(*(np.concatenate([x, y]) for x, y in ((self.g, other.g), (self.s, other.s), (self.e, other.e))))

    def __len__(self) -> int:
        return len(self.g)


class Tree:
    """A reduction tree that grows from the left: lists are merged when one as large as itself has come."""

    def __init__(self) -> None:
        self.parts: list[Lists] = []

    def add(self, lists: Lists) -> None:
        while self.parts and len(self.parts[-1]) <= 2 * len(lists):
            lists = self.parts.pop().merge(lists)
        self.parts.append(lists)

    def __len__(self) -> int:
        return sum(map(len, self.parts))

    def close(self) -> Lists | None:
        while len(self.parts) > 1:
            last = self.parts.pop()
            self.parts.append(self.parts.pop().merge(last))
        return self.parts.pop() if self.parts else None


class _Groups:
    """Numbers for the keys of groups, in order of their coming."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, keys: pa.Array) -> np.ndarray:
        coded = keys.dictionary_encode()
        numbers = np.array([self.known.setdefault(k, len(self.known)) for k in coded.dictionary.to_pylist()], np.int64)
        return numbers[coded.indices.to_numpy()] if len(numbers) else np.empty(0, np.int64)

    def names(self) -> list[str]:
        return list(self.known)


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _as_rows(lists: Lists, names: list[str]) -> Iterator[pa.RecordBatch]:
    """One row per group: its key and its list as two arrays."""
    at = np.flatnonzero(np.append(True, lists.g[1:] != lists.g[:-1])) if len(lists) else np.empty(0, np.int64)
    offsets = pa.array(np.append(at, len(lists)), pa.int32())
    keys = pa.array([names[g] for g in lists.g[at].tolist()], pa.string())
    yield pa.record_batch([keys, pa.ListArray.from_arrays(offsets, pa.array(lists.s)), pa.ListArray.from_arrays(offsets, pa.array(lists.e))], names=["kb", "s", "e"])


def _partial_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of the rows (key, s, e) of a task; handed on early if there are many."""
    groups, tree = _Groups(), Tree()
    for batch in batches:
        if batch.num_rows:
            tree.add(Lists.of(groups.of(batch.column(0)), _longs(batch.column(1)), _longs(batch.column(2))))
        if len(tree) > HELD:
            yield from _as_rows(tree.close(), groups.names())
            groups, tree = _Groups(), Tree()
    if (done := tree.close()) is not None:
        yield from _as_rows(done, groups.names())


_OPEN = "kb string, s bigint, prev bigint, end bigint, last bigint, first_of_bucket boolean, last_of_bucket boolean"


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The intervals that open a period, from the partial lists of whole buckets and what reaches into them.

    Rows are (key, s, e, before, last): lists, and one row per bucket without a list that says how far earlier buckets
    reach (``before``, null if there are none) and the key's last end.
    """
    groups, tree = _Groups(), Tree()
    reach: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = groups.of(batch.column(0))
        s, e = batch.column(1), batch.column(2)
        sizes = s.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        if sizes.sum():
            tree.add(Lists.of(np.repeat(g, sizes), _longs(s.flatten()), _longs(e.flatten())))
        told = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
        low = np.iinfo(np.int64).min
        reach.append((g[told], _longs(batch.column(3).fill_null(low))[told], _longs(batch.column(4).fill_null(0))[told]))
    lists = tree.close()
    if lists is None:
        return
    low = np.iinfo(np.int64).min
    before, last = np.full(len(groups.known), low), np.zeros(len(groups.known), np.int64)
    for g, b, z in reach:
        before[g], last[g] = b, z
    first = np.append(True, lists.g[1:] != lists.g[:-1])
    prev = np.maximum(before[lists.g], np.where(first, low, np.append(low, lists.e[:-1])))
    # Ends in a bucket's list grow, so the end before is how far the bucket itself reaches.
    at = np.flatnonzero((prev == low) | (lists.s > prev))
    if not len(at):
        return
    g, s, prev = lists.g[at], lists.s[at], prev[at]
    head, foot = np.append(True, g[1:] != g[:-1]), np.append(g[1:] != g[:-1], True)
    end = np.append(prev[1:], 0)
    names = np.array(groups.names(), object)
    yield pa.record_batch(
        [pa.array(names[g], pa.string()), pa.array(s), pa.array(prev, mask=prev == low), pa.array(end, mask=foot), pa.array(last[g]), pa.array(head), pa.array(foot)], names=["kb", "s", "prev", "end", "last", "first_of_bucket", "last_of_bucket"]
    )


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``keys, kind, start_ms, end_ms``: one 'period' per merged stretch and one 'gap' between neighbouring periods.

    ``start`` and ``end`` are whole milliseconds (long columns). Intervals that overlap, nest or touch form one
    period. Rows with a null key, a null time, or an end not after the start count as absent; repeated rows, ties and
    an empty input need no care (an empty input gives an empty result). Other columns are ignored, whatever their
    names.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{k}`").cast("string").alias(a) for a, k in zip(ks, keys)], F.col(f"`{start}`").cast("long").alias("s"), F.col(f"`{end}`").cast("long").alias("e"))
    rows = rows.dropna().filter("e > s").withColumn("b", F.expr(f"floor(s / {int(bucket_ms)}D)"))
    kb = F.to_json(F.struct(*ks, "b")).alias("kb")
    parts = f"struct<{', '.join(f'{k}: string' for k in ks)}, b: bigint>"
    of = lambda df: df.withColumn("k", F.from_json("kb", parts)).select("*", "k.*").drop("k")
    # Lists of the map tasks, written once: how far they reach and their merging both start here.
    lists = cut_lineage(rows.select(kb, "s", "e").mapInArrow(_partial_lists, "kb string, s array<bigint>, e array<bigint>"))
    reach = of(lists.groupBy("kb").agg(F.max(F.element_at("e", -1)).alias("hi")))
    per_key = Window.partitionBy(*ks).orderBy("b")
    reach = reach.select("kb", F.max("hi").over(per_key.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.max("hi").over(Window.partitionBy(*ks)).alias("last"))
    none = F.lit(None).cast("array<bigint>")
    both = lists.select("kb", "s", "e", F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("last")).unionByName(reach.select("kb", none.alias("s"), none.alias("e"), "before", "last"))
    opened = cut_lineage(both.repartition("kb").mapInArrow(_opened, _OPEN))
    # The last period of a bucket ends before the first that a later bucket opens, else with the key.
    edges = of(opened.filter("first_of_bucket OR last_of_bucket"))
    edges = edges.withColumn("end", F.when(F.col("last_of_bucket"), F.coalesce(F.lead("prev").over(Window.partitionBy(*ks).orderBy("b", "s")), F.col("last"))).otherwise(F.col("end")))
    columns = [*ks, "s", "prev", "end"]
    closed = of(opened.filter("NOT (first_of_bucket OR last_of_bucket)")).select(*columns).unionByName(edges.select(*columns))
    two = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s").alias("start_ms"), F.col("end").alias("end_ms")),
        F.struct(F.lit("gap").alias("kind"), F.col("prev").alias("start_ms"), F.col("s").alias("end_ms")),
    )
    out = closed.select(*ks, F.explode(two).alias("x")).filter("x.start_ms IS NOT NULL")
    return out.select(*[F.col(a).alias(k) for a, k in zip(ks, keys)], "x.kind", "x.start_ms", "x.end_ms")


def to_millis(seconds):
    """Whole milliseconds of a double column of seconds, halves away from zero; NaN and infinities give null."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e15)
    return F.when(finite, F.round(c * 1000).cast("long"))


def speaking_periods(df: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Continuous speaking periods and gaps of diarization rows, per source and speaker.

    Speakers are the same if they differ only in case or outer blanks and are put out in upper case without these;
    ``df`` holds current rows.
    """
    clean = df.select(
        F.col("source_id"),
        F.upper(F.regexp_replace("speaker", r"(?U)^\s+|\s+$", "")).alias("speaker"),
        to_millis("start").alias("s"),
        to_millis("end").alias("e"),
    )
    return merge_intervals(clean, ["source_id", "speaker"], "s", "e", bucket_ms)
