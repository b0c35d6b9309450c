"""Text quality statistics per document, and which documents are lists, tables or junk rather than prose.

Every statistic, those of the lines included (shares of short items, of rows of the same columns, of lines without a
letter or digit), gets a mergeable quantile sketch per language, built over all documents; a document's values become
percentiles and robust z-scores within its language, and far tails are flagged. The quantiles of a language are shrunk
towards those of the merged sketch by its number of documents; documents without a known language are judged by the
merged sketch of all documents, their own included. The middles and scales of the statistics that tell kinds apart are
bounded, so that what is far from prose stays in a tail whatever its own share of a language is.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from turnstone.session import cut_lineage

#: Statistics that are sketched, with the smallest scale a z-score assumes.
SKETCHED = {"n_words": 5.0, "mean_word_length": 0.5, "symbol_ratio": 0.03, "punct_line_share": 0.15, "common_share": 0.05, "readable_share": 0.05, "distinct_share": 0.1, "item_line_share": 0.02, "row_line_share": 0.02, "junk_line_share": 0.02}
#: Of these, shares of a text's lines.
LINES = ("item_line_share", "row_line_share", "junk_line_share")
#: A sketch's bins grow by this factor, and are about so wide near zero.
GROWTH = 1.01
LEAST_WIDTH = 0.001
#: The merged sketch counts as so many documents beside a language's own.
LEAST_DOCUMENTS = 30
TAIL = 5.0
#: A text below these lies in the low tail in every language, however many of its language's documents are like it.
LEAST_SHARE = {"readable_share": 0.7, "distinct_share": 0.4}
#: The middle of readable and distinct shares is taken to be at least, that of line shares at most so much.
ORDINARY = {"readable_share": 0.95, "distinct_share": 0.9, "item_line_share": 0.2, "row_line_share": 0.2, "junk_line_share": 0.2}

_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_WORD = re.compile(r"[^\W_]+(?:['’‘\-][^\W_]+)*")
_ENDS = tuple(".!?…।:;。！？\"'”’»)")
_SENTENCE_END = tuple(".!?…।。！？")
_MARK = re.compile(
    r"^\s*(?:[-*+•▪◦‣·–—☐☑☒✓✔✗□■►➤→○●]|[\[(]?\d{1,3}[.):\]]|\(?(?:[a-zA-Z]|[ivxIVX]{2,5})[.)]|[\[(]?\d{1,3}:\d{2}(?::\d{2})?[\])]?(?:\s*[-–—])?|\[[ xX]\])\s+(?=\S)"
)
_HTML_ROW = re.compile(r"^\s*</?(?:table|thead|tbody|tr|td|th)\b", re.I)
_RULE = re.compile(r"^[\s|+:=-]+$")
_NUMBER = re.compile(r"^[+-]?[\d.,:%/$€£-]*\d[\d.,:%/$€£-]*$")
_ALNUM = re.compile(r"[^\W_]")
_NO_ALNUM = re.compile(r"[\W_]+")
_VOWEL = re.compile("[aeiouyáàâäãåæéèêëíìîïóòôöõøœúùûüýÿаеёиоуыэюяіїє]")
_CLUSTER = re.compile("[bcdfghjklmnpqrstvwxzßçñбвгджзклмнпрстфхцчшщ]{7,}")
#: Letters with the marks, joiners and hyphens that stand inside words.
_LETTERS = re.compile(r"(?:[^\W\d]|['’‘\-./@\u0900-\u0dff\u0300-\u036f\u200c\u200d])+")
#: Scripts that put no spaces between words: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _letters_only(core: str) -> bool:
    if _LETTERS.fullmatch(core):
        return True
    # Marks of the scripts that the pattern does not list.
    return not core.isascii() and bool(_LETTERS.fullmatch("".join(c for c in core if unicodedata.category(c)[0] != "M")))


@lru_cache(maxsize=200_000)
def readable(token: str) -> bool | None:
    """Whether a token between white space looks like a word; None for numbers, times and lone punctuation."""
    core = token.strip(".,;:!?…।。！？，、；：،؛؟۔\"'“”„«»‘’「」『』（）()[]{}<>|/*#_-–—•☐☑♪@&")
    if not core:
        return None
    if _NUMBER.match(core):
        return None
    unspaced = len(_UNSPACED.findall(core))
    if unspaced:
        return unspaced * 2 > len(core)
    if len(core) > 40 or not _letters_only(core):
        return False
    low = core.lower()
    if not (core == low or core[1:] == low[1:] or core == core.upper() or "-" in core or "'" in core or "’" in core or core[:2] in ("Mc", "O'")):
        return False
    if low.isascii() or "Ѐ" <= low[0] <= "ӿ":
        if len(low) > 1 and (not _VOWEL.search(low) or _CLUSTER.search(low)) and not (core == core.upper() and len(core) < 6):
            return False
        if re.search(r"(.)\1\1", low):
            return False
    return True


#: What a separator shows as, how a line is split by it, least cells, and whether most rows must hold a number.
_SEPARATORS = (
    ("\t", lambda x: x.split("\t"), 2, False),
    ("|", lambda x: x.strip().strip("|").split("|"), 2, False),
    ("  ", lambda x: re.split(r"\s{2,}|\t", x.strip()), 2, False),
    (";", lambda x: x.split(";"), 2, True),
    (",", lambda x: x.split(","), 2, True),
)


def _columns(lines: list[str]) -> list[bool]:
    """Which lines are rows of the same columns as others."""
    n = len(lines)
    row = [bool(_HTML_ROW.match(x)) for x in lines]
    for mark, split, least, numeric in _SEPARATORS:
        if sum(mark in x for x in lines) < 2:
            continue
        cells = [[c.strip() for c in split(x)] for x in lines]
        counts = Counter(len(c) for c in cells if len(c) >= least)
        if not counts:
            continue
        mode, times = counts.most_common(1)[0]
        if times < 2 or times < 0.6 * sum(counts.values()):
            continue
        fit = [len(c) == mode and sum(len(x.split()) for x in c) <= 3 * mode for c in cells]
        numbers = sum(f and any(_NUMBER.match(x) for x in c) for f, c in zip(fit, cells))
        if sum(fit) < 2 or (numeric and numbers < 0.5 * sum(fit)):
            continue
        row = [a or b for a, b in zip(row, fit)]
    return [a or (bool(_RULE.match(lines[i])) and "|" in lines[i] and (row[i - 1] or row[(i + 1) % n])) for i, a in enumerate(row)]


def _is_item(line: str) -> bool:
    """A short item or tags, with or without a mark."""
    text = line.strip()
    tokens = text.split()
    if all(t.startswith("#") and len(t) > 1 for t in tokens):
        return True
    m = _MARK.match(line)
    body = line[m.end() :].strip() if m else text
    n = len(body.split())
    if m:
        return n <= 8 and not body.endswith(_SENTENCE_END)
    return n <= 5 and not body.endswith((*_SENTENCE_END, ":", ",")) and bool(_ALNUM.search(body))


def measure(text: str | None, common: dict[str, tuple[str, ...]]) -> dict | None:
    """All statistics of one text; None for null and blank texts. ``common``: the languages of each frequent word."""
    if text is None:
        return None
    text = _INVISIBLE.sub("", text)
    if not text.strip():
        return None
    lines = [x for x in _BREAK.split(text) if x.strip()]
    words = [w.lower() for w in _WORD.findall(text)]
    tokens = text.split()
    seen = [r for r in map(readable, tokens) if r is not None]
    alnum = len(_NO_ALNUM.sub("", text))
    solid = sum(map(len, tokens))
    n_grams = len(tokens) - 2
    distinct = len(set(zip(tokens, tokens[1:], tokens[2:]))) / n_grams if n_grams >= 10 else 1.0
    hits = Counter(chain.from_iterable(common[w] for w in words if w in common))
    row = _columns(lines)
    n_row = sum(row)
    n_item = n_junk = 0
    for line, is_row in zip(lines, row):
        if is_row:
            continue
        if not _ALNUM.search(line):
            n_junk += 1
        elif _is_item(line):
            n_item += 1
    return {
        "n_words": len(words),
        "mean_word_length": sum(map(len, words)) / len(words) if words else 0.0,
        "symbol_ratio": 1 - alnum / solid,
        "punct_line_share": sum(x.rstrip().endswith(_ENDS) for x in lines) / len(lines),
        "common_share": max(hits.values()) / len(words) if hits else 0.0,
        "readable_share": sum(seen) / len(seen) if seen else (1.0 if n_row * 2 > len(lines) else 0.0),
        "distinct_share": distinct,
        "n_lines": len(lines),
        "n_item_lines": n_item,
        "n_row_lines": n_row,
        "n_junk_lines": n_junk,
    }


STATS = T.StructType([T.StructField(k, T.LongType() if k.startswith("n_") else T.DoubleType()) for k in ("n_words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_share", "readable_share", "distinct_share", "n_lines", "n_item_lines", "n_row_lines", "n_junk_lines")])
_ARROW = pa.struct([(f.name, pa.int64() if f.name.startswith("n_") else pa.float64()) for f in STATS.fields])


def statistics(text: Column, common: dict[str, tuple[str, ...]]) -> Column:
    """Struct column of the statistics; null for null and blank texts."""

    @F.arrow_udf(STATS)
    def stats(texts: pa.Array) -> pa.Array:
        return pa.array([measure(t, common) for t in texts.to_pylist()], _ARROW)

    return stats(text)


def common_words(words: DataFrame, most: int = 100_000) -> dict[str, tuple[str, ...]]:
    """The languages of each word of the vocabulary table, on the driver; refuses a table of more than ``most`` rows."""
    rows = words.filter("lang IS NOT NULL AND word IS NOT NULL").select("lang", F.lower("word").alias("word")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} common words")
    out: dict[str, tuple[str, ...]] = {}
    for r in sorted(rows):
        out[r["word"]] = (*out.get(r["word"], ()), r["lang"])
    return out


def _language(lang: Column) -> Column:
    """The two or three letters that a label begins with; 'und' for a label that has no such form."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(F.regexp_replace(lang, r"(?U)^\s+|\s+$", "")), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit("")), F.lit("und"))


def _shares(s: str) -> dict[str, Column]:
    """The sketched statistics of the struct ``s``; those of the lines are shares of all lines."""
    line = lambda k: F.col(f"{s}.n_{k}_lines") / F.col(f"{s}.n_lines")
    return {k: line(k.removesuffix("_line_share")) if k in LINES else F.col(f"{s}.{k}").cast("double") for k in SKETCHED}


def sketches(measured: DataFrame) -> DataFrame:
    """``lang, stat, bin, n``: a mergeable quantile sketch of every statistic per language, and of all together ('*').

    A sketch is a histogram whose bins grow with the value (values of one bin differ by 1 % at most, or by 0.001 near
    zero); adding up bins merges sketches, so the result does not depend on how the rows are split or ordered.
    """
    each = F.array(*[F.struct(F.lit(k).alias("stat"), _bin(x).alias("bin")) for k, x in _shares("s").items()])
    rows = measured.select("lang", F.explode(each).alias("x")).groupBy("lang", "x.stat", "x.bin").agg(F.count("*").alias("n"))
    return rows.unionByName(rows.groupBy("stat", "bin").agg(F.sum("n").alias("n")).withColumn("lang", F.lit("*")))


def _bin(x: Column) -> Column:
    """Number of the bin of a value that is not negative: linear near zero, then growing by ``GROWTH``."""
    return F.round(F.log1p(F.greatest(x, F.lit(0.0)) * ((GROWTH - 1) / LEAST_WIDTH)) / math.log(GROWTH) * 1.0).cast("int")


def _value(b: Column) -> Column:
    """The value that stands for a bin."""
    return F.expm1(b * math.log(GROWTH)) * (LEAST_WIDTH / (GROWTH - 1))


def quantiles(sketch: DataFrame, points: int = 101) -> DataFrame:
    """``lang, n, <stat>``: the values at ``points`` even ranks of every sketch, smallest first.

    Swept over the bins of one sketch, whose number is bounded by the range of a double, not by the rows.
    """
    upto = F.sum("n").over(Window.partitionBy("lang", "stat").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy("lang", "stat"))
    rows = sketch.withColumn("upto", upto).withColumn("total", total)
    # The ranks that a bin holds: rank i of 0 .. points - 1 stands at row i * (total - 1) / (points - 1), counted from 0.
    first = F.ceil((F.col("upto") - F.col("n")) * (points - 1) / F.greatest(F.col("total") - 1, F.lit(1)) - 1e-9)
    last = F.floor((F.col("upto") - 1) * (points - 1) / F.greatest(F.col("total") - 1, F.lit(1)) + 1e-9)
    alone = F.col("total") == 1
    ranks = F.when(alone, F.lit(points)).otherwise(F.greatest(last - first + 1, F.lit(0))).cast("int")
    rows = rows.withColumn("times", ranks)
    grid = rows.groupBy("lang", "stat").agg(F.max("total").alias("n"), F.array_sort(F.collect_list(F.struct("bin", "times"))).alias("bins"))
    spread_out = F.flatten(F.transform("bins", lambda b: F.array_repeat(_value(b["bin"]), b["times"])))
    return grid.select("lang", "stat", "n", spread_out.alias("q")).groupBy("lang").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("stat") == k, F.col("q"))).alias(k) for k in SKETCHED])


def score(df: DataFrame, doc_id: str, text: str, lang: str, common: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per document: its statistics, percentiles, robust z-scores, tails and ``kind``.

    ``kind`` is 'prose', 'list', 'table', 'junk', or null for null and blank texts. ``tails`` names the statistics in
    a far tail (|z| > 5) of the document's language. What may be a list, a table or junk is what lies in the far tail
    of the shares of item lines, of rows of the same columns and of lines without a letter or digit, or in the low
    tail of readable tokens or of distinct phrases; of these, lists, tables and wordless texts must have most of their
    lines so. Scores depend on the rows alone, not on how they are split. Repeated rows are kept as they are.
    """
    rows = df.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{lang}`").alias("l"), statistics(F.col(f"`{text}`"), common).alias("s")).withColumn("lang", _language(F.col("l").cast("string")))
    # Measured once and written without the texts: the sketches and the scores both read it.
    rows = cut_lineage(rows)
    grid = quantiles(sketches(rows.filter("s IS NOT NULL")))
    # Written, so that its real size decides whether it is broadcast.
    grid = cut_lineage(grid)
    merged = grid.filter("lang = '*'").select(*[F.col(k).alias(f"m_{k}") for k in SKETCHED])  # one row
    shrunk = lambda k: F.zip_with(k, f"m_{k}", lambda q, m: (q * F.col("n") + m * LEAST_DOCUMENTS) / (F.col("n") + LEAST_DOCUMENTS))
    own = grid.crossJoin(F.broadcast(merged)).select(F.col("lang").alias("key"), *[F.when(F.col("lang") == "*", F.col(k)).otherwise(shrunk(k)).alias(f"q_{k}") for k in SKETCHED])
    rows = rows.withColumn("key", F.when(F.col("lang") == "und", "*").otherwise(F.col("lang"))).join(own, "key", "left")
    z, pct = {}, {}
    at = lambda k, rank: F.get(f"q_{k}", F.lit(rank))
    for k, x in _shares("s").items():
        middle, width = at(k, 50), at(k, 75) - at(k, 25)
        if k in LEAST_SHARE:  # junk lies in the lower half of these; neither scale nor middle may move with it
            width, middle = 2 * (at(k, 75) - at(k, 50)), F.greatest(middle, F.lit(ORDINARY[k]))
            width = F.least(width, (middle - LEAST_SHARE[k]) / TAIL * 1.349)
        if k in LINES:  # lists, tables and junk lie in the upper half of these
            width, middle = 2 * (at(k, 50) - at(k, 25)), F.least(middle, F.lit(ORDINARY[k]))
            width = F.least(width, (0.5 - middle) / TAIL * 1.349)
        z[k] = F.round((x - middle) / F.greatest(width / 1.349, F.lit(SKETCHED[k])), 3)
        pct[k] = F.greatest(F.size(F.filter(f"q_{k}", lambda g, x=x: g <= x * (1 + 1e-9))) - 1, F.lit(0)) / 100
    rows = rows.withColumns({f"z_{k}": v for k, v in z.items()} | {f"pct_{k}": F.when(F.col("s").isNotNull(), v) for k, v in pct.items()})
    tails = F.filter(F.array(*[F.when(F.abs(F.col(f"z_{k}")) > TAIL, F.lit(k)) for k in SKETCHED]), lambda t: t.isNotNull())
    low = lambda k: F.col(f"z_{k}") < -TAIL
    mostly = lambda k: (F.col(f"z_{k}_line_share") > TAIL) & (F.col(f"s.n_{k}_lines") * 2 > F.col("s.n_lines"))
    kind = (
        F.when(F.col("s").isNull(), None)
        .when(low("distinct_share") | mostly("junk"), "junk")
        .when(mostly("row") & ~(low("readable_share") & (F.col("s.n_lines") < 2)), "table")
        .when(low("readable_share"), "junk")
        .when(mostly("item"), "list")
        .otherwise("prose")
    )
    out = rows.withColumn("kind", kind).withColumn("tails", tails)
    return out.select(F.col("i").alias(doc_id), F.col("l").alias("language"), *[F.col(f"s.{f.name}").alias(f.name) for f in STATS.fields], *[f"pct_{k}" for k in SKETCHED], *[f"z_{k}" for k in SKETCHED], "tails", "kind")
