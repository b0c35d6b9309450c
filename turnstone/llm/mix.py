"""Mixing sources to target shares of the total size, in tokens.

A classifier fitted on the labelled table gives every document posteriors over the domains (the sources that have a
target). The memberships of a document with a source are its posteriors blended with its label; those of a document
without one are its posteriors alone. Rates (how often a document is used, between 0 and its source's ``max_repeats``)
are fitted by distributed projected-gradient least squares so that the expected tokens of each domain meet its target.
The last steps of the descent take the labels at their word, so that the totals by source are met too, or every document
of the source is used as often as it may be and a residual stays: such a source is short. Documents of alike
memberships, source and cap have equal rates, so the descent runs over groups of them, not over documents; a pass adds
up one small vector per task and only their sum reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from turnstone.llm.tokens import RANKS, n_tokens
from turnstone.session import cut_lineage

#: Labelled rows that the domain classifier is fitted on: all of them up to this number, beyond it about this number,
#: drawn evenly by the hash of the id.
FIT_ROWS = 20_000
FEATURES = 1 << 13
#: Memberships that agree in so many steps share one row of the descent, which keeps the sums of what they really are.
STEPS = 16
ROUNDS = 30
#: Weight of a document's own label beside the classifier's posteriors.
TRUST = 0.75
#: Rows of the target table at most (the classifier's weights grow with it, 64 KB each); a larger one is refused.
MOST_TARGETS = 1_000
#: Documents whose rates are rounded to whole uses together.
ROUNDED = 10_000


def source_name(source: str | Column) -> Column:
    """Sources are the same if they differ only in case or outer blanks; a blank one is none."""
    c = F.col(source) if isinstance(source, str) else source
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def _features(text: str) -> np.ndarray:
    """Hashed words and word pairs of a text, without repeats."""
    words = text.lower().split()
    grams = {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}
    return np.fromiter((xxhash.xxh64_intdigest(g) % FEATURES for g in grams), np.int64, len(grams))


def fit_domains(labelled: DataFrame, text: str, domain: str, n: int, per_source: dict[int, int], rows: int = FIT_ROWS) -> np.ndarray:
    """Log weights (domains x features) of a naive Bayes classifier on about ``rows`` labelled documents at most.

    ``domain``: number of the document's domain; ``per_source``: labelled documents of each. Copies of a text are drawn
    and counted like the documents they are.
    """
    share = min(1.0, rows / max(sum(per_source.values()), 1))
    sample = labelled.filter(F.col(domain).isNotNull() & (F.pmod(F.xxhash64("i", text), F.lit(1_000_000)) < F.lit(round(share * 1_000_000))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, FEATURES + 1))
        for batch in batches:
            for t, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                np.add.at(total[d], _features(t or ""), 1)
                total[d, FEATURES] += 1
        k, j = np.nonzero(total)
        yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[k, j])], names=["k", "j", "n"])

    cells = sample.select(F.col(text), F.col(domain)).mapInArrow(count, "k int, j int, n double").groupBy("k", "j").agg(F.sum("n").alias("n"))
    counts = np.zeros((n, FEATURES + 1))
    for r in cells.collect():  # at most domains x features cells
        counts[r["k"], r["j"]] = r["n"]
    docs = counts[:, FEATURES]
    smooth = np.log(counts[:, :FEATURES] + 0.5) - np.log(docs[:, None] + 1.0)
    prior = np.where(docs > 0, np.log(docs + 0.5) - math.log(docs.sum() + 0.5 * n), -1e9)  # none labelled: no posterior
    return np.concatenate([smooth, prior[:, None]], axis=1)


def memberships(docs: DataFrame, text: str, domain: str, weights: np.ndarray, trust: float) -> DataFrame:
    """``docs`` with ``p``: shares by domain that sum to 1, the posteriors blended with the label where there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # domains x features, bounded

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def member(texts: pa.Array, labels: pa.Array) -> pa.Array:
        w, out = shared.value, []
        for t, d in zip(texts.to_pylist(), labels.to_pylist()):
            f = _features(t or "")
            score = w[:, FEATURES] + w[:, f].sum(axis=1) / math.sqrt(max(len(f), 1))
            p = np.exp(score - score.max())
            p /= p.sum()
            if d is not None:
                p *= 1 - trust
                p[d] += trust
            out.append(p)
        flat = np.concatenate([*out, np.empty(0, np.float32)]).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(w), pa.int32()), pa.array(flat)).cast(pa.list_(pa.float32()))

    return docs.withColumn("p", member(F.col(text), F.col(domain)))


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), k)


def _vector(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def rates(q: np.ndarray, d: np.ndarray, cap: np.ndarray, history: list[np.ndarray], shift: np.ndarray | None = None) -> np.ndarray:
    """Rates after all rounds of ``history``: steps along the membership's residual, clipped to 0..cap each time.

    ``shift``: by how much the rates of each source are moved in the end; documents without a source (-1) stay.
    """
    r = np.zeros(len(q))
    weight = np.maximum(q.sum(axis=1), 1e-9)
    for residual in history:
        r = np.clip(r + (q @ residual) / weight, 0.0, cap)
    if shift is not None:
        r = np.clip(r + np.append(shift, 0.0)[d.astype(int)], 0.0, cap)
    return r


def _sums(groups: DataFrame, width: int, values) -> np.ndarray:
    """Sum over all groups of the vectors that ``values(q, d, cap, tokens, mass)`` gives for the rows of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                k = len(batch.column(0)[0])
                total += values(_matrix(batch.column(0), k), _vector(batch.column(1)), _vector(batch.column(2)), _vector(batch.column(3)), _matrix(batch.column(4), k))
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["t"])

    rows = groups.select("q", "d", "cap", "tokens", "mass").mapInArrow(run, "t array<double>").collect()  # one small vector per task
    return np.sum([r["t"] for r in rows] or [[0.0] * width], axis=0)


def fit_rates(groups: DataFrame, goal: np.ndarray, rounds: int = ROUNDS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(history, expected tokens by domain, shift, tokens by source) of the fit on ``groups`` (``q, d, cap, tokens, mass``).

    First projected gradient on the expected tokens by domain: a group's rate in any round follows from the residuals
    before it, so no state is kept per group and a lost executor costs nothing but recomputation. Then, with the labels
    taken at their word, the rates of each source are shifted until its tokens meet the goal. That is piecewise linear
    in the shift, and Newton's step on it needs a few rounds; where no rate is left to grow, the residual stays.
    """
    k = len(goal)
    have = _sums(groups, k, lambda q, d, cap, tokens, mass: mass.sum(axis=0))
    step = 1.0 / np.maximum(have, 1.0)
    history: list[np.ndarray] = []
    reached = np.zeros(k)
    for _ in range(rounds):
        residual = (goal - reached) * step
        if np.all(np.abs(goal - reached) <= 1e-6 * np.maximum(goal, 1.0)):
            break
        if history and np.allclose(residual, history[-1], rtol=1e-6, atol=1e-9):
            break  # every rate that still lacks tokens is at its cap
        history.append(residual)
        reached = _sums(groups, k, lambda q, d, cap, tokens, mass: (mass * rates(q, d, cap, history)[:, None]).sum(axis=0))

    def by_source(q, d, cap, tokens, mass):
        r = rates(q, d, cap, history, shift)
        own = d >= 0
        at, free = d[own].astype(int), (r[own] > 0) & (r[own] < cap[own])
        return np.concatenate([np.bincount(at, (r * tokens)[own], k), np.bincount(at, tokens[own] * free, k), np.bincount(at, (cap * tokens)[own], k)])

    shift = np.zeros(k)
    low, high = np.full(k, -np.inf), np.full(k, np.inf)
    for _ in range(60):
        found = _sums(groups, 3 * k, by_source)
        used, free, most = found[:k], found[k : 2 * k], found[2 * k :]
        residual = goal - used
        full = used >= most
        done = (np.abs(residual) <= 1e-9 * np.maximum(goal, 1.0)) | (full & (residual > 0)) | ((used <= 0) & (residual <= 0))
        if done.all():
            break
        low, high = np.where(residual > 0, np.maximum(low, shift), low), np.where(residual < 0, np.minimum(high, shift), high)
        newton = shift + residual / np.where(free > 0, free, np.maximum(most, 1.0))
        bounded = np.isfinite(low) & np.isfinite(high)
        middle = np.where(bounded, (np.where(bounded, low, 0.0) + np.where(bounded, high, 0.0)) / 2, newton)
        inside = (newton > low) & (newton < high) & ((free > 0) | ~bounded)
        shift = np.where(done, shift, np.where(inside, newton, middle))
    return history, reached, shift, used


def targets_of(targets: DataFrame, most: int = MOST_TARGETS) -> list[tuple[str, float, int]]:
    """The target table on the driver; one row per source (its largest share and cap), refused beyond ``most`` rows."""
    rows = targets.select(source_name("source").alias("s"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap"))
    rows = rows.filter("s IS NOT NULL").groupBy("s").agg(F.max(F.coalesce("share", F.lit(0.0))).alias("share"), F.max(F.coalesce("cap", F.lit(0))).alias("cap")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} targets")
    return sorted((r["s"], r["share"], max(r["cap"], 0)) for r in rows)


_REPORT = "source string, target_share double, max_repeats int, corpus_tokens bigint, own_tokens bigint, goal_tokens double, expected_tokens double, own_fitted_tokens double, fitted_share double, short boolean"


def mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", trust: float = TRUST, unlabelled_uses: int = 0, total_tokens: int | None = None, ranks: str = RANKS) -> tuple[DataFrame, DataFrame]:
    """(rates, report) of a mix as large as the corpus (or ``total_tokens``).

    rates: ``doc_id, domain, tokens, rate`` for every row with tokens; ``rate`` is the expected number of uses. report:
    one row per target: ``source, target_share, max_repeats, corpus_tokens, own_tokens, goal_tokens, expected_tokens,
    own_fitted_tokens, fitted_share, short``. ``expected_tokens`` is the domain's total by memberships,
    ``own_fitted_tokens`` the total of the source's own documents. ``short``: a residual of the fit stays, with every
    document of the source used ``max_repeats`` times.

    All rows count, repeated ones too. Null and empty texts have no tokens. Sources are the same if they differ only in
    case or outer blanks. A document without a source, or of one without a target, has no source of its own; it may be
    used ``unlabelled_uses`` times (by default not at all: it would count in the mix, but for no source), and its
    tokens count in the corpus. Empty tables give empty results; columns not named are ignored.
    """
    spark = docs.sparkSession
    wanted = targets_of(targets)
    k = len(wanted)
    rows = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").cast("string").alias("x"), source_name(F.col(f"`{source}`")).alias("s"))
    numbers = F.create_map(*[F.lit(x) for n, (s, _, _) in enumerate(wanted) for x in (s, n)]) if wanted else None
    rows = rows.withColumn("d", F.element_at(numbers, F.col("s")) if wanted else F.lit(None).cast("int")).drop("s")
    caps = F.array(*[F.lit(c) for _, _, c in wanted]) if wanted else None
    cap = F.coalesce(F.get(caps, F.col("d")) if wanted else F.lit(None).cast("int"), F.lit(unlabelled_uses))
    if wanted:
        per_source = {r["d"]: r["count"] for r in rows.filter("d IS NOT NULL").groupBy("d").count().collect()}  # one row per target
        weights = fit_domains(rows, "x", "d", k, per_source)
        rows = memberships(rows, "x", "d", weights, trust)
    else:
        rows = rows.withColumn("p", F.array().cast("array<float>"))
    # Tokens are counted once and written without the texts.
    q = F.transform("p", lambda x: F.round(x * STEPS) / STEPS)
    sized = cut_lineage(rows.select("i", "d", n_tokens("x", ranks).cast("long").alias("tokens"), "p", cap.alias("cap")).withColumn("q", q))
    mass = F.array(*[F.sum(F.col("p")[n] * F.col("tokens")) for n in range(k)]) if k else F.array().cast("array<double>")
    groups = sized.groupBy("q", "d", "cap").agg(F.sum("tokens").alias("tokens"), mass.alias("mass")).withColumn("d", F.coalesce("d", F.lit(-1)))
    groups = cut_lineage(groups)
    own = {r["d"]: r["t"] for r in groups.groupBy("d").agg(F.sum("tokens").alias("t")).collect()}  # one row per target
    corpus = sum(x or 0 for x in own.values())
    total = corpus if total_tokens is None else total_tokens
    goal = np.array([share * total for _, share, _ in wanted])
    history, expected, shift, used = fit_rates(groups, goal) if wanted else ([], np.zeros(0), np.zeros(0), np.zeros(0))
    everything = float(used.sum())
    report = []
    for n, (s, share, c) in enumerate(wanted):
        # At its cap every rate is exact, and so is the residual.
        short = used[n] < goal[n] and used[n] >= (own.get(n) or 0) * c
        report.append((s, share, c, int(corpus), int(own.get(n) or 0), float(goal[n]), float(expected[n]), float(used[n]), float(used[n]) / everything if everything else 0.0, bool(short)))

    @F.arrow_udf(T.DoubleType())
    def rate(q: pa.Array, d: pa.Array, cap: pa.Array) -> pa.Array:
        return pa.array(rates(_matrix(q, k), _vector(d.fill_null(-1)), _vector(cap), history, shift))

    domain = F.get(F.array(*[F.lit(s) for s, _, _ in wanted]), F.col("d")) if wanted else F.lit(None).cast("string")
    fitted = sized.filter("tokens > 0").select(F.col("i").alias(doc_id), domain.alias("domain"), "tokens", rate("q", "d", "cap").alias("rate") if wanted else F.lit(0.0).alias("rate"))
    return fitted, spark.createDataFrame(report, _REPORT)


def whole_uses(fitted: DataFrame, doc_id: str = "doc_id", rounded: int = ROUNDED) -> DataFrame:
    """``fitted`` with ``uses``: rates rounded to whole numbers, up or down, so that the tokens of a source stay what they are.

    The documents of a source are dealt into parts of about ``rounded`` by their ids, those of a part are ordered by
    size, and every one is used as often as the running sum of rates passes a whole number; so a part misses its sum by
    less than one document, and no source is sorted in one task.
    """
    n = fitted.groupBy("domain").agg(F.ceil(F.count("*") / rounded).cast("int").alias("parts"))  # one row per domain
    key = F.xxhash64(doc_id, "tokens", "rate")
    rows = fitted.join(F.broadcast(n.select(F.col("domain").alias("__d"), "parts")), F.col("domain").eqNullSafe(F.col("__d"))).withColumn("__part", F.pmod(key, "parts"))
    upto = F.sum("rate").over(Window.partitionBy("domain", "__part").orderBy("tokens", doc_id, key).rowsBetween(Window.unboundedPreceding, 0))
    begin = F.pmod(F.xxhash64("domain", "__part"), F.lit(1000)) / 1000.0
    rows = rows.withColumn("__upto", F.round(upto + begin, 9))
    before = F.lag("__upto").over(Window.partitionBy("domain", "__part").orderBy("tokens", doc_id, key))
    return rows.withColumn("uses", (F.floor("__upto") - F.floor(F.coalesce(before, F.round(begin, 9)))).cast("int")).drop("__d", "parts", "__part", "__upto")


def records(fitted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: ``doc_id, domain, tokens, use`` with one row for every use of a document, ``use`` counted from 1."""
    uses = whole_uses(fitted, doc_id).filter("uses > 0")
    return uses.select(doc_id, "domain", "tokens", F.explode(F.sequence(F.lit(1), "uses")).alias("use"))


def reached_shares(fitted: DataFrame, report: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The report with what the mix really holds: ``mixed_documents, mixed_tokens, most_uses, actual_share``."""
    held = whole_uses(fitted, doc_id).groupBy("domain").agg(F.sum("uses").alias("mixed_documents"), F.sum(F.col("uses") * F.col("tokens")).alias("mixed_tokens"), F.max("uses").alias("most_uses"))
    held = cut_lineage(held)  # one row per target
    total = held.agg(F.sum("mixed_tokens").alias("total"))
    out = report.join(held.withColumnRenamed("domain", "__d"), F.col("source") == F.col("__d"), "left").crossJoin(F.broadcast(total)).drop("__d")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return out.withColumns({"mixed_documents": zero("mixed_documents"), "mixed_tokens": zero("mixed_tokens"), "most_uses": F.coalesce("most_uses", F.lit(0)), "actual_share": F.coalesce(F.try_divide("mixed_tokens", "total"), F.lit(0.0))}).drop("total")
