"""Timestamps of subtitles, shown and read, and small arithmetic on durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions.text import col


def _clock(seconds: Column) -> tuple[Column, Column, Column]:
    whole = F.floor(seconds)
    return F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60))


def clock(seconds: str | Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm (``mark`` before the milliseconds). Milliseconds may show 1000, as the format's writers do."""
    s = col(seconds)
    h, m, sec = _clock(s)
    ms = F.bround((s - F.floor(s)) * 1000).cast("int")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", h, m, sec, ms)


def clock_short(seconds: str | Column) -> Column:
    h, m, sec = _clock(col(seconds))
    return F.format_string("%02d:%02d:%02d", h, m, sec)


def seconds_of(stamp: str | Column) -> Column:
    """Seconds of H:M:S, M:S or S with , or . before the fraction; null if it is none of these."""
    parts = F.split(F.replace(col(stamp), F.lit(","), F.lit(".")), ":")
    value = F.aggregate(parts, F.lit(0.0).cast("double"), lambda acc, p: acc * 60 + F.try_to_number(p, F.lit("999999999D999999")).cast("double"))
    return F.when(F.size(parts) <= 3, value)


def millis(seconds: str | Column) -> Column:
    return F.round(col(seconds) * 1000).cast("long")


def backoff(attempt: str | Column, base: float = 1.0, most: float = 60.0) -> Column:
    """Doubling delay from ``base`` at the first attempt, at most ``most``; without jitter."""
    return F.round(F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.greatest(col(attempt) - 1, F.lit(0)))), 3)


def confidence_of(log_probability: str | Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(col(log_probability))))
