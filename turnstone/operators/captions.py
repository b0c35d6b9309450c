"""Timed segments inside a row: folding them to text, and writing them as subtitles. No operator here shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions.text import col, collapse_blanks, let, remove_sound_tags, strip, unescape_all, unescape_entities, words
from turnstone.functions.timing import clock

SEGMENTS = "array<struct<text string, start double, duration double, confidence double, speaker string>>"
_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def segment_tokens(text: Column) -> Column:
    """A caption's words with sound tags gone; entities are decoded before."""
    return words(remove_sound_tags(text))


def _texts(segments: str | Column) -> Column:
    """The segments' texts with all entities decoded."""
    return unescape_all(F.transform(F.coalesce(col(segments), F.array().cast(SEGMENTS)), lambda s: s["text"]))


def deflickered(segments: str | Column, most: int = 8) -> Column:
    """Chunks of words with what a rolling caption repeats left out, as an array of arrays of words.

    A caption that begins with the last words of the last caption that added any (case aside, the longest overlap up
    to ``most`` words) adds only the rest; one that adds nothing is skipped and is not remembered.
    """
    low = lambda xs: F.transform(xs, F.lower)

    def overlap(prev: Column, now: Column) -> Column:
        room = F.least(F.size(prev), F.size(now), F.lit(most))
        sizes = F.sequence(F.lit(0), room)
        return F.array_max(F.filter(sizes, lambda k: low(F.slice(prev, F.size(prev) - k + 1, k)) == low(F.slice(now, F.lit(1), k))))

    # The fold keeps the last caption and how much of this one repeats it; a caption's own step never copies what came before.
    def fold(tokens: Column) -> Column:
        def step(acc: Column, now: Column) -> Column:
            return let(overlap(acc["prev"], now), lambda over: F.struct(F.array_append(acc["cuts"], over).alias("cuts"), F.when(over >= F.size(now), acc["prev"]).otherwise(now).alias("prev")))

        empty = F.struct(F.array().cast("array<int>").alias("cuts"), _none().alias("prev"))
        cuts = F.aggregate(tokens, empty, step, lambda acc: acc["cuts"])
        rest = F.zip_with(tokens, cuts, lambda now, over: F.slice(now, over + 1, F.size(now)))
        return F.filter(rest, lambda r: F.size(r) > 0)

    return let(F.transform(_texts(segments), segment_tokens), fold)


def paragraphs(tokens: Column, least: int = 150) -> Column:
    """Text of ``tokens`` with a blank line after the first sentence end at or past every ``least`` words.

    The fold runs over the places of sentence ends only, a much shorter array than the words.
    """

    def text(t: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), lambda i: F.get(t, i - 1).rlike("[.?!]$"))
        breaks = F.aggregate(at, F.array(F.lit(0)), lambda acc, i: F.when(i - F.element_at(acc, -1) >= least, F.concat(acc, F.array(i))).otherwise(acc))
        return let(F.array_distinct(F.concat(breaks, F.array(F.size(t)))), lambda edges: joined(t, edges))

    def joined(t: Column, edges: Column) -> Column:
        n = F.size(edges) - 1
        pairs = F.arrays_zip(F.slice(edges, F.lit(1), n).alias("a"), F.slice(edges, F.lit(2), n).alias("b"))
        return F.array_join(F.transform(pairs, lambda p: F.array_join(F.slice(t, p["a"] + 1, p["b"] - p["a"]), " ")), "\n\n")

    return let(tokens, text)


def normal_text(segments: str | Column, raw_text: str | Column, least: int = 150) -> Column:
    """Clean text of a transcript: its segments without flicker, or its raw text, in paragraphs; '' if wordless."""
    have = F.size(F.coalesce(col(segments), F.array().cast(SEGMENTS))) > 0
    tokens = F.when(have, F.flatten(deflickered(segments))).otherwise(segment_tokens(unescape_entities(F.coalesce(col(raw_text), F.lit("")))))
    return strip(collapse_blanks(paragraphs(tokens, least)))


def _end(s: Column) -> Column:
    return F.coalesce(s["start"], F.lit(0.0)) + F.coalesce(s["duration"], F.lit(0.0))


def _start(s: Column) -> Column:
    return F.coalesce(s["start"], F.lit(0.0))


def to_srt(segments: str | Column) -> Column:
    cue = lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), clock(_start(s)), F.lit(" --> "), clock(_end(s)), F.lit("\n"), F.coalesce(s["text"], F.lit("")), F.lit("\n"))
    return F.array_join(F.transform(col(segments), cue), "\n")


def to_vtt(segments: str | Column) -> Column:
    cue = lambda s: F.concat(clock(_start(s), "."), F.lit(" --> "), clock(_end(s), "."), F.lit("\n"), F.coalesce(s["text"], F.lit("")), F.lit("\n"))
    return F.array_join(F.concat(F.array(F.lit("WEBVTT\n")), F.transform(col(segments), cue)), "\n")


def to_json(segments: str | Column, text: str | Column, language: str | Column, **meta: str | Column) -> Column:
    """One JSON object: the metadata, language, text, and segments with times to the millisecond. Nulls are kept."""
    cue = lambda s: F.struct(F.round(_start(s), 3).alias("start"), F.round(_end(s), 3).alias("end"), F.round(s["duration"], 3).alias("duration"), s["text"].alias("text"), s["confidence"].alias("confidence"))
    fields = [col(c).alias(k) for k, c in meta.items()]
    return F.to_json(F.struct(*fields, col(language).alias("language"), col(text).alias("text"), F.transform(col(segments), cue).alias("segments")), {"ignoreNullFields": "false"})


# A cue of SRT and VTT files, from its times to the next blank line.
CUE = r"(?s)(\d{1,2}:\d{2}:\d{2}[,.]\d{3})[ \t]*-->[ \t]*(\d{1,2}:\d{2}:\d{2}[,.]\d{3})(.*?)(?=\r?\n[ \t]*\r?\n|\z)"


def parse_cues(content: str | Column) -> Column:
    """Segments of a whole SRT or VTT file. Cues without text are dropped; times need hours, as the writers give."""
    from turnstone.functions.text import single_spaced, strip_markup
    from turnstone.functions.timing import seconds_of

    part = lambda n: F.regexp_extract_all(col(content), F.lit(CUE), F.lit(n))
    cues = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("t"))

    def segment(c: Column) -> Column:
        start, end = seconds_of(c["a"]), seconds_of(c["b"])
        return F.struct(
            single_spaced(strip_markup(c["t"])).alias("text"), start.alias("start"), F.greatest(F.lit(0.0), end - start).alias("duration"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("speaker")
        )

    return F.filter(F.transform(cues, segment), lambda s: s["text"] != "")


def packed(segments: str | Column, most: int = 100) -> Column:
    """Array of chunks of whole segments with at most ``most`` words each; a longer segment is a chunk of its own.

    Every chunk: ``chunk, start, end, n_words, text, speaker`` (distinct speakers, sorted, joined by a comma).
    """
    chunk = "struct<start double, end double, words array<string>, speakers array<string>>"

    def step(acc: Column, seg: Column) -> Column:
        return let(words(seg["text"]), lambda now: add(acc, seg, now))

    def add(acc: Column, seg: Column, now: Column) -> Column:
        cur = acc["cur"]
        spoken_by = F.when(F.coalesce(seg["speaker"], F.lit("")) != "", F.array(seg["speaker"])).otherwise(_none())
        fresh = F.struct(_start(seg).alias("start"), _end(seg).alias("end"), now.alias("words"), spoken_by.alias("speakers"))
        grown = F.struct(cur["start"].alias("start"), _end(seg).alias("end"), F.concat(cur["words"], now).alias("words"), F.array_union(cur["speakers"], spoken_by).alias("speakers"))
        full = F.size(cur["words"]) + F.size(now) > most
        return (
            F.when(F.size(now) == 0, acc)
            .when(cur.isNull(), F.struct(acc["done"].alias("done"), fresh.alias("cur")))
            .when(full, F.struct(F.concat(acc["done"], F.array(cur)).alias("done"), fresh.alias("cur")))
            .otherwise(F.struct(acc["done"].alias("done"), grown.alias("cur")))
        )

    empty = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), F.lit(None).cast(chunk).alias("cur"))
    done = F.aggregate(F.coalesce(col(segments), F.array().cast(SEGMENTS)), empty, step, lambda acc: F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))
    return F.transform(
        done,
        lambda c, i: F.struct(
            i.alias("chunk"),
            c["start"].alias("start"),
            c["end"].alias("end"),
            F.size(c["words"]).alias("n_words"),
            F.array_join(c["words"], " ").alias("text"),
            F.nullif(F.array_join(F.array_sort(c["speakers"]), ", "), F.lit("")).alias("speaker"),
        ),
    )
