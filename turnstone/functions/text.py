"""Column functions on text: words, clean-up, character and word ratios, names of files."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode and Python's split() see it; Java's \s knows ASCII only.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NOT_WS = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"

# Sound annotations of subtitles.
SOUND_TAGS = r"(?i)\[(?:Music|Applause|Laughter|Cheering|Silence|Music Plays|Background Noise|Inaudible)\]|\((?:applause|cheering|laughter)\)"

# English function words.
ENGLISH_WORDS = """a about after all am an and any are as at be because been before being but by can could did do does
down for from had has have he her here him his how i if in into is it its me more my no not of off on only or other our
out over same she so some such than that the their them then there these they this those through to too under up very
was we were what when where which while who whom why with would you your""".split()

# Words of Hindi in Latin letters.
HINGLISH_WORDS = """kya kyun kyunki nahi nahin karna karein karenge hota hoti hote hoga hai hain kaise yahan wahan dekho
samajh bhai bacho bachon padhai karo accha bahut thoda lekin agar jaise pehle sabse sirf matlab chalo yeh woh hum tum
aap bolo batao""".split()

# Device names that no file may have.
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]

# Characters that no file name may have.
NOT_IN_NAMES = r'[\x00-\x1f\\/*?:"<>|]'

# Secrets in log lines, and what stands for them.
SECRETS = [r"tx_(?:live|test)_[a-zA-Z0-9]{20,40}", r"(?i)Bearer\s+[a-zA-Z0-9._\-]+", r"(?i)password['\"]?\s*[:=]\s*['\"]?[^'\"]+['\"]?"]
REDACTED = "[REDACTED_SECRET]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often (and inside which lambdas) the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: str | Column) -> Column:
    return F.regexp_replace(col(c), f"^{WS}+|{WS}+$", "")


def words(c: str | Column) -> Column:
    """Words between white space; an empty array for blank and null texts."""
    return F.coalesce(F.regexp_extract_all(col(c), F.lit(f"{NOT_WS}+"), F.lit(0)), F.array().cast("array<string>"))


def word_count(c: str | Column) -> Column:
    """Words without building an array; 0 for null."""
    return F.coalesce(F.regexp_count(col(c), F.lit(f"{NOT_WS}+")), F.lit(0))


def single_spaced(c: str | Column) -> Column:
    return strip(F.regexp_replace(col(c), f"{WS}+", " "))


def collapse_blanks(c: str | Column) -> Column:
    """Runs of blanks and tabs to one blank, three and more line breaks to two."""
    return F.regexp_replace(F.regexp_replace(col(c), "[ \t]+", " "), "\n{3,}", "\n\n")


def unescape_basic(c: str | Column) -> Column:
    """The five XML entities, the no-break space and the usual numeric quotes, inside the JVM."""
    out = col(c)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&#34;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


@F.arrow_udf(T.StringType())
def _unescape(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None or "&" not in t else html.unescape(t) for t in texts.to_pylist()], pa.string())


def unescape_entities(c: str | Column) -> Column:
    """All HTML entities, named and numeric; Arrow batches, since Spark has no such function.

    Only texts with an ampersand leave the JVM.
    """
    return F.coalesce(_unescape(F.when(F.contains(col(c), F.lit("&")), col(c))), col(c))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _unescape_each(lists: pa.Array) -> pa.Array:
    return pa.array([x if x is None else [t if t is None else html.unescape(t) for t in x] for x in lists.to_pylist()], pa.list_(pa.string()))


def unescape_all(texts: Column) -> Column:
    """``unescape_entities`` of every text of an array; only arrays with an ampersand leave the JVM."""
    return F.coalesce(_unescape_each(F.when(F.exists(texts, lambda t: F.contains(t, F.lit("&"))), texts)), texts)


def remove_sound_tags(c: str | Column) -> Column:
    return F.regexp_replace(col(c), SOUND_TAGS, " ")


def strip_markup(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "<[^<>]*>", "")


def latin_ratio(c: str | Column) -> Column:
    """Letters of the Latin script among all letters; null without letters."""
    return F.try_divide(F.regexp_count(col(c), F.lit(r"\p{IsLatin}")), F.regexp_count(col(c), F.lit(r"\p{L}")))


def abnormal_count(c: str | Column) -> Column:
    """Characters that are replacement marks or not printable, line breaks and tabs aside."""
    return F.regexp_count(col(c), F.lit(r"[\p{C}\p{Z}\x{fffd}&&[^ \n\r\t]]"))


def abnormal_ratio(c: str | Column) -> Column:
    return F.coalesce(F.try_divide(abnormal_count(c), F.length(col(c))), F.lit(0.0))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` successive tokens, joined by blanks; empty where there are fewer."""

    def grams(t: Column) -> Column:
        k = F.greatest(F.size(t) - (n - 1), F.lit(0))
        out = F.slice(t, F.lit(1), k)
        for i in range(2, n + 1):
            out = F.zip_with(out, F.slice(t, F.lit(i), k), lambda a, b: F.concat(a, F.lit(" "), b))
        return out

    return let(tokens, grams)


def repeated_ngrams(tokens: Column, n: int = 3) -> Column:
    """Runs of ``n`` tokens that repeat an earlier one."""
    return let(ngrams(tokens, n), lambda g: F.size(g) - F.size(F.array_distinct(g)))


def repetition_ratio(tokens: Column, n: int = 3) -> Column:
    return let(ngrams(tokens, n), lambda g: F.coalesce(F.try_divide(F.size(g) - F.size(F.array_distinct(g)), F.size(g)), F.lit(0.0)))


def ascii_tokens(c: str | Column) -> Column:
    """Whole words of two and more ASCII letters, in lower case."""
    runs = F.coalesce(F.regexp_extract_all(col(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.array().cast("array<string>"))
    return F.transform(F.filter(runs, lambda w: w.rlike("^[a-zA-Z]{2,}$")), F.lower)


def hits(tokens: Column, vocabulary: list[str]) -> Column:
    """Tokens that are in a fixed vocabulary, repeats included."""
    return F.size(F.filter(tokens, lambda t: t.isin(vocabulary)))


def redact(c: str | Column) -> Column:
    out = col(c)
    for pattern in SECRETS:
        out = F.regexp_replace(out, pattern, REDACTED)
    return out


def file_name(c: str | Column, fallback: str = "transcript") -> Column:
    """A safe base name: no separators or control characters, blanks as underscores, reserved names led by safe_."""
    clean = F.regexp_replace(F.coalesce(col(c), F.lit("")), NOT_IN_NAMES, "")
    clean = F.btrim(F.regexp_replace(clean, f"{WS}+", "_"), F.lit(" ._"))
    reserved = F.upper(F.split_part(clean, F.lit("."), F.lit(1))).isin(RESERVED_NAMES)
    clean = F.when(reserved, F.concat(F.lit("safe_"), clean)).otherwise(clean)
    return F.when(clean == "", F.lit(fallback)).otherwise(F.left(clean, F.lit(80)))


def escapes_root(c: str | Column) -> Column:
    """Whether a relative path leaves its root, is absolute, or holds a null byte."""
    path = F.replace(col(c), F.lit("\\"), F.lit("/"))
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")),
        lambda acc, part: F.struct(
            (acc["at"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)).alias("at"),
            F.least(acc["least"], acc["at"] + F.when(part == "..", -1).otherwise(0)).alias("least"),
        ),
        lambda acc: acc["least"],
    )
    return (depth < 0) | F.startswith(path, F.lit("/")) | F.contains(path, F.lit("\x00"))


def content_type(path: str | Column) -> Column:
    ext = F.lower(F.regexp_extract(col(path), r"\.([^./\\]+)$", 1))
    return F.when(ext == "json", "application/json").when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "png", "image/png").when(ext == "csv", "text/csv").otherwise("text/plain")


def percent(share: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", share * 100)
