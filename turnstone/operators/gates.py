"""Language and quality gates, and one status per source. Failures are columns, never exceptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions import text as X


def _decision(ok: bool | Column, detected: str | Column, confidence: float, reason: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(ok).alias("is_acceptable"), lit(detected).alias("detected_language"), F.lit(confidence).alias("confidence"), reason.alias("reason"))


def language_decision(text: str | Column, code: str | Column, target: str = "auto") -> Column:
    """Struct ``is_acceptable, detected_language, confidence, reason`` of a transcript against the wanted language.

    'auto' accepts any language. English is checked by the declared code, the share of Latin letters, words of
    Hindi in Latin letters, and the share of function words; any other target by the declared code alone.
    """
    return X.let(X.strip(F.coalesce(X.col(text), F.lit(""))), lambda t: _decide(t, X.col(code), target.lower()))


def _decide(t: Column, c: Column, target: str) -> Column:
    declared = F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    known = F.coalesce(declared != "unknown", F.lit(False))
    prefix = F.split_part(F.lower(declared), F.lit("-"), F.lit(1))
    wordless = _decision(False, "unknown", 0.0, F.lit("empty"))
    if target == "auto":
        return F.when(t == "", wordless).otherwise(_decision(True, F.coalesce(declared, F.lit("unknown")), 1.0, F.lit("any language")))
    if not target.startswith("en"):
        match = known & (prefix == target.split("-")[0])
        return F.when(t == "", wordless).when(match, _decision(True, declared, 1.0, F.lit("declared"))).otherwise(_decision(False, F.coalesce(declared, F.lit("unknown")), 0.80, F.lit("not verified")))
    return X.let(X.ascii_tokens(t), lambda tokens: _english(t, tokens, wordless, declared, known & (prefix != "en")))


def _english(t: Column, tokens: Column, wordless: Column, declared: Column, other: Column) -> Column:
    n = F.size(tokens)
    return (
        F.when(t == "", wordless)
        .when(other, _decision(False, declared, 1.0, F.lit("declared")))
        .when(F.coalesce(X.latin_ratio(t), F.lit(1.0)) < 0.80, _decision(False, "non_latin_script", 0.95, F.lit("script")))
        .when((n >= 10) & (X.hits(tokens, X.HINGLISH_WORDS) / n > 0.08), _decision(False, "hinglish", 0.90, F.lit("vocabulary")))
        .when((n >= 20) & (X.hits(tokens, X.ENGLISH_WORDS) / n < 0.10), _decision(False, "low_english_density", 0.85, F.lit("function words")))
        .otherwise(_decision(True, "en", 0.95, F.lit("verified")))
    )


def quality(text: str | Column, n_segments: Column, mean_confidence: Column, min_words: int = 20, min_chars: int = 100, max_repetition: float = 0.35, max_abnormal: float = 0.05) -> Column:
    """Struct ``status, is_usable, word_count, character_count, segment_count, repeated, grams, abnormal, reasons``.

    EMPTY and SHORT texts are not usable; a loop or corrupt characters make a text SUSPICIOUS, which overrides SHORT.
    ``repeated`` of ``grams`` word 3-grams and ``abnormal`` of the characters are whole numbers, so ratios are exact.
    """

    def count(t: Column) -> Column:
        tokens = X.words(t)
        measured = lambda w: F.struct(F.size(w).alias("n"), F.length(t).alias("chars"), X.repeated_ngrams(w).alias("repeated"), X.abnormal_count(t).alias("abnormal"))
        return X.let(tokens, measured)

    counts = X.let(X.strip(F.coalesce(X.col(text), F.lit(""))), count)
    return X.let(counts, lambda m: _assess(m, n_segments, mean_confidence, min_words, min_chars, max_repetition, max_abnormal))


def _assess(m: Column, n_segments: Column, mean_confidence: Column, min_words: int, min_chars: int, max_repetition: float, max_abnormal: float) -> Column:
    n, chars, repeated, abnormal = m["n"], m["chars"], m["repeated"], m["abnormal"]
    grams = F.greatest(n - 2, F.lit(0))
    loops = (repeated > grams * max_repetition) & (n >= 80)
    corrupt = abnormal > chars * max_abnormal
    few, brief = n < min_words, chars < min_chars
    unsure = F.coalesce(mean_confidence < 0.5, F.lit(False))
    reasons = F.array_compact(F.array(F.when(few, "few words"), F.when(brief, "few characters"), F.when(loops, "repeated phrases"), F.when(corrupt, "abnormal characters"), F.when(unsure, "low confidence")))
    status = F.when(n == 0, "EMPTY").when(loops | corrupt, "SUSPICIOUS").when(few | brief, "SHORT").otherwise("GOOD")
    return F.struct(
        status.alias("status"),
        status.isin("GOOD", "SUSPICIOUS").alias("is_usable"),
        n.alias("word_count"),
        F.when(n == 0, 0).otherwise(chars).alias("character_count"),
        F.coalesce(n_segments, F.lit(0)).alias("segment_count"),
        repeated.alias("repeated"),
        grams.alias("grams"),
        abnormal.alias("abnormal"),
        F.when(n == 0, F.array(F.lit("empty"))).otherwise(reasons).alias("reasons"),
    )


def mean_confidence(segments: str | Column) -> Column:
    """Mean over the segments that have a confidence; null if none has."""
    have = F.filter(F.transform(X.col(segments), lambda s: s["confidence"]), lambda c: c.isNotNull() & ~F.isnan(c))
    return F.try_divide(F.aggregate(have, F.lit(0.0), lambda a, c: a + c), F.size(have))


def outcome(decision: Column, assessed: Column, found: Column) -> Column:
    """Struct ``status, error_category``: the first stage that fails wins."""
    bad = lambda category: F.struct(F.lit("FAILED").alias("status"), F.lit(category).alias("error_category"))
    return (
        F.when(~found, bad("NO_TRANSCRIPT"))
        .when(~decision["is_acceptable"], bad("LANGUAGE_MISMATCH"))
        .when(~assessed["is_usable"], bad("QUALITY_FAILURE"))
        .otherwise(F.struct(F.lit("SUCCESS").alias("status"), F.lit(None).cast("string").alias("error_category")))
    )


def media_problem(duration_seconds: str | Column, size_bytes: str | Column, most_seconds: float = 7200, most_bytes: int = 1 << 30) -> Column:
    """Why a file is too large to process, null if it is not."""
    d, b = X.col(duration_seconds), X.col(size_bytes)
    return F.when(d > most_seconds, F.format_string("duration %.1f s over %.1f s", d, F.lit(float(most_seconds)))).when(b > most_bytes, F.format_string("size %.1f MiB over %.1f MiB", b / F.lit(1048576.0), F.lit(most_bytes / 1048576.0)))
