"""Cutting oversized texts into overlapping pieces at natural boundaries.

Recursive bisection: a stretch of words over the limit is cut at the strongest boundary near its middle, and each half
again while it exceeds the limit less the overlap; then every piece but the first is led by the last words of the one
before. Whole texts are handled, row by row, without any shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: characters that end a sentence, and line breaks.
SENTENCE_END = ".!?…।"
LINE_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
CLAUSE_END = ",;:—–"
_WORD = re.compile(r"[^\s]+")

PIECE = "array<struct<piece int, text string, first_word int, n_words int, overlap int, forced boolean, share_from double, share_to double>>"
RESULT = f"struct<n_words int, cut string, pieces {PIECE}>"


def _spans(text: str) -> list[tuple[int, int]]:
    """Words as Python's white space separates them (no-break and ideographic spaces included)."""
    return [m.span() for m in _WORD.finditer(text)]


def boundary_strengths(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """For the place after each word: 4 blank line, 3 line break after a sentence, 2 sentence end or line break, 1 clause end, else 0."""
    out = np.zeros(len(spans), np.int8)
    for i, (a, b) in enumerate(spans):
        last = text[b - 1]
        gap = text[b : spans[i + 1][0]] if i + 1 < len(spans) else ""
        breaks = 0 if gap in ("", " ") else len(LINE_BREAK.findall(gap))
        ends = last in SENTENCE_END
        if breaks > 1:
            out[i] = 4
        elif breaks and ends:
            out[i] = 3
        elif breaks or ends:
            out[i] = 2
        elif last in CLAUSE_END:
            out[i] = 1
    return out


def cut_points(strengths: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Cuts as (words before the cut, words of the stretch that had no natural boundary to cut at, else 0), in order.

    Natural boundaries are used up before a stretch is cut elsewhere, so the first such cut of a stretch sees it whole,
    from one natural boundary (or end of the text) to the next.
    """
    n, cuts, todo = len(strengths), [], [(0, len(strengths))]
    natural = np.flatnonzero(strengths >= 2) + 1
    clause = np.flatnonzero(strengths >= 1) + 1
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= (limit if lo == 0 else limit - overlap):
            continue
        mid, quarter = (lo + hi) / 2, (hi - lo) / 4
        inside = natural[np.searchsorted(natural, lo + 1) : np.searchsorted(natural, hi)]
        near = inside[np.abs(inside - mid) <= quarter]
        forced = 0
        if len(near):
            best = near[np.lexsort((near, np.abs(near - mid), -strengths[near - 1].astype(int)))[0]]
        elif len(inside):
            best = inside[np.argmin(np.abs(inside - mid))]
        else:
            forced = hi - lo
            soft = clause[np.searchsorted(clause, lo + 1) : np.searchsorted(clause, hi)]
            soft = soft[np.abs(soft - mid) <= quarter]
            best = soft[np.argmin(np.abs(soft - mid))] if len(soft) else (lo + hi) // 2
        cuts.append((int(best), forced))
        todo += [(lo, int(best)), (int(best), hi)]
    return sorted(cuts)


def split_text(text: str | None, limit: int = 150, overlap: int = 20) -> dict:
    """The pieces of one text; a text within the limit is one piece, a null or blank one has none."""
    spans = _spans(text or "")
    n = len(spans)
    if not n:
        return {"n_words": 0, "cut": "none", "pieces": []}
    if n <= limit:
        cuts, cut = [], "none"
    else:
        strengths = boundary_strengths(text, spans)
        cuts = cut_points(strengths, limit, overlap)
        cut = "forced" if any(run > limit for _, run in cuts) else "natural"
    edges = [(0, 0), *cuts, (n, 0)]
    pieces = []
    for p, ((lo, _), (hi, forced)) in enumerate(zip(edges, edges[1:])):
        lead = min(overlap, lo) if p else 0
        pieces.append({"piece": p, "text": text[spans[lo - lead][0] : spans[hi - 1][1]], "first_word": lo - lead, "n_words": hi - lo + lead, "overlap": lead, "forced": bool(forced), "share_from": lo / n, "share_to": hi / n})
    return {"n_words": n, "cut": cut, "pieces": pieces}


def content_key(row_id: str, content: list[str]):
    """What tells rows without an id apart; null where there is an id, so that the id alone counts."""
    return F.when(F.col(f"`{row_id}`").isNull(), F.struct(*[F.col(f"`{c}`") for c in content]))


def split_items(df: DataFrame, item_id: str = "chunk_id", text: str = "text", start: str = "start_timestamp", end: str = "end_timestamp", limit: int = 150, overlap: int = 20, content: list[str] | None = None) -> DataFrame:
    """``item_id, n_words, cut, piece, text, first_word, piece_words, overlap, forced, start, end`` of every piece.

    A piece has at most ``limit`` words, of which the first ``overlap`` repeat the end of the piece before. The time
    of the item is shared out by its own words; null, NaN or reversed times give pieces without times, equal ones give
    every piece the same time. ``cut``: 'none' (within the limit), 'natural', or 'forced' if the bisection met a stretch
    of more than ``limit`` words without a natural boundary in it. Null and blank texts have no pieces; an item that
    is delivered repeatedly (same id) is split once; if its rows differ, the greatest text (then times) counts. Items without an id are told apart by the columns of ``content``,
    by default text and times: a null id folds nothing but repeats of the same content. Other columns are left out,
    whatever their names.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")

    @F.pandas_udf(RESULT)
    def pieces(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_text(t, limit, overlap) for t in texts], columns=["n_words", "cut", "pieces"])

    items = df.select(
        F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("x"), F.col(f"`{start}`").cast("double").alias("a"), F.col(f"`{end}`").cast("double").alias("b"), content_key(item_id, content or [text, start, end]).alias("c")
    )
    items = items.groupBy("i", "c").agg(F.max(F.struct("x", "a", "b")).alias("r")).select("i", "r.*")
    timed = F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.isnan("a") & ~F.isnan("b") & (F.col("b") >= F.col("a"))
    # Not taken for deterministic, so that the planner does not evaluate it again for filters on its result.
    rows = items.withColumn("r", pieces.asNondeterministic()("x")).select("i", "a", "b", "r.n_words", "r.cut", F.explode("r.pieces").alias("p"))
    at = lambda share: F.when(timed, F.round(F.col("a") + (F.col("b") - F.col("a")) * F.col(share), 3))
    return rows.select(
        F.col("i").alias(item_id), "n_words", "cut", "p.piece", "p.text", "p.first_word", F.col("p.n_words").alias("piece_words"), "p.overlap", "p.forced", at("p.share_from").alias(start), at("p.share_to").alias(end)
    )
