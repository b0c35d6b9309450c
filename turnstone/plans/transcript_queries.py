"""Registered queries on transcripts: text measures, caption folds, subtitles, gates, fingerprints and repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import hashing as H
from turnstone.functions import text as X
from turnstone.operators import captions as C
from turnstone.operators import dedup as D
from turnstone.operators import gates as G
from turnstone.session import spread, table


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "raw_transcript"))


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("raw_text", F.lit(""))
    return _transcripts(spark, sf_dir).select(
        "transcript_id",
        X.word_count(t).alias("n_words"),
        F.length(X.strip(t)).alias("n_chars"),
        X.abnormal_count(t).alias("abnormal"),
        F.regexp_count(t, F.lit(r"\p{L}")).alias("letters"),
        F.size(X.ascii_tokens(t)).alias("ascii_words"),
        X.hits(X.ascii_tokens(t), X.ENGLISH_WORDS).alias("english_words"),
        X.hits(X.ascii_tokens(t), X.HINGLISH_WORDS).alias("hinglish_words"),
        X.repeated_ngrams(X.words(t)).alias("repeated_grams"),
    )


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.single_spaced(X.remove_sound_tags(X.unescape_entities("text")))
    return table(spark, sf_dir, "transcript_segment").select("seg_id", X.strip_markup(text).alias("text"))


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" sent Bearer abc.DEF-"), F.col("event_id").cast("string"), F.lit(' and password="x1"'))
    return table(spark, sf_dir, "events").select("event_id", X.redact(line).alias("line"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_item").select("item_id", X.file_name(F.coalesce(F.nullif("title", F.lit("")), "source_id")).alias("file_name"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", H.sha256("text").alias("text_hash"), H.sha256(H.canonical_text("text")).alias("canonical_hash"), H.stable_id("doc_", "source", "text").alias("stable_id"))


def xxhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents by their 64-bit fingerprint, with how many documents share each."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(H.normalized_hash("text").alias("fingerprint"))
    return docs.groupBy("fingerprint").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("contents"))


def deflicker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _transcripts(spark, sf_dir).filter("segments IS NOT NULL")
    return rows.select("transcript_id", F.array_join(F.flatten(C.deflickered("segments")), " ").alias("text"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transcripts(spark, sf_dir).select("transcript_id", C.normal_text("segments", "raw_text", least=60).alias("text"))


def srt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transcripts(spark, sf_dir).filter("segments IS NOT NULL").select("transcript_id", C.to_srt("segments").alias("srt"))


def vtt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transcripts(spark, sf_dir).filter("segments IS NOT NULL").select("transcript_id", C.to_vtt("segments").alias("vtt"))


def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _transcripts(spark, sf_dir).select("transcript_id", "segments", C.to_json("segments", "raw_text", "language_code", source_id="source_id").alias("json"))
    doc = F.from_json("json", "source_id string, language string, text string, segments array<struct<start double, end double, duration double, text string, confidence double>>")
    return rows.withColumn("d", doc).select("transcript_id", "d.source_id", "d.language", "d.text", F.coalesce(F.size("d.segments"), F.lit(0)).alias("n_segments"), _json_cues("d.segments").alias("cues"))


def _json_cues(segments: str) -> Column:
    """Segments as lines of start, end and text, times in milliseconds."""
    ms = lambda x: F.round(x * 1000).cast("long").cast("string")
    return F.array_join(F.transform(segments, lambda s: F.concat_ws(" ", ms(s["start"]), ms(s["end"]), F.when(s["confidence"].isNull(), "-").otherwise("c"), s["text"])), "\n")


def subtitle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written as SRT and read again."""
    rows = _transcripts(spark, sf_dir).filter("segments IS NOT NULL").select("transcript_id", C.parse_cues(C.to_srt("segments")).alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.round(x["start"] * 1000).cast("long"))
    return rows.select("transcript_id", F.size("s").alias("n"), total.alias("start_ms"), F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"))


def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _transcripts(spark, sf_dir).select("transcript_id", F.explode(C.packed("segments", 40)).alias("c"))
    return rows.select("transcript_id", "c.chunk", F.round(F.col("c.start") * 1000).cast("long").alias("start_ms"), F.round(F.col("c.end") * 1000).cast("long").alias("end_ms"), "c.n_words", "c.text", H.sha256("c.text").alias("provenance_hash"))


def _gate(target: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = G.language_decision("raw_text", "language_code", target)
        return _transcripts(spark, sf_dir).select("transcript_id", d.alias("d")).select("transcript_id", "d.is_acceptable", "d.detected_language", "d.confidence")

    return run


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _transcripts(spark, sf_dir)
    text = C.normal_text("segments", "raw_text")
    return rows.withColumn("q", G.quality(text, F.size("segments"), G.mean_confidence("segments")))


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).select("transcript_id", "q.status", "q.is_usable", "q.word_count", "q.character_count", "q.segment_count", "q.repeated", F.array_join("q.reasons", ", ").alias("reasons"))


def quality_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts and words per declared language and quality."""
    lang = F.coalesce(F.nullif(F.lower(F.trim("language_code")), F.lit("")), F.lit("unknown"))
    return _assessed(spark, sf_dir).groupBy(lang.alias("language"), F.col("q.status").alias("status")).agg(F.count("*").alias("n"), F.sum(F.col("q.word_count").cast("long")).alias("n_words"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assessed(spark, sf_dir).withColumn("d", G.language_decision("raw_text", "language_code", "en"))
    return rows.select("transcript_id", G.outcome(F.col("d"), F.col("q"), F.col("raw_text").isNotNull()).alias("o")).groupBy("o.status", "o.error_category").agg(F.count("*").alias("n"))


def content_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.content_owner(table(spark, sf_dir, "documents"), "doc_id", "text", "doc_id").select("doc_id", "owner", "status")


def source_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that were found again, marked against the first discovery of their source."""
    return D.mark_repeats(table(spark, sf_dir, "source_item").select("item_id", "source_id", "discovered_at"), "source_id", "discovered_at", "item_id")


def first_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.first_seen(table(spark, sf_dir, "source_item").select("source_id", "discovered_at"), "source_id", "discovered_at")


def sources_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.not_done(table(spark, sf_dir, "source_item").select("source_id", "item_id").distinct(), _transcripts(spark, sf_dir), "source_id")


def sources_to_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.new_only(table(spark, sf_dir, "transcript_segment"), table(spark, sf_dir, "source_item").select("source_id", "discovered_at"), "source_id", "discovered_at")


def known_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "collection")
    return D.known_content(docs.filter("collection IS NULL"), "text", docs.filter("collection IS NOT NULL"), "text").select("doc_id")


QUERIES = {
    "quality_by_language": quality_by_language,
    "text_measures": text_measures,
    "clean_text": clean_text,
    "redacted": redacted,
    "file_names": file_names,
    "fingerprints": fingerprints,
    "xxhash_groups": xxhash_groups,
    "deflicker": deflicker,
    "paragraphs": paragraphs,
    "srt_export": srt_export,
    "vtt_export": vtt_export,
    "json_export": json_export,
    "subtitle_round_trip": subtitle_round_trip,
    "packed_chunks": packed_chunks,
    "language_gate_auto": _gate("auto"),
    "language_gate_en": _gate("en"),
    "language_gate_es": _gate("es"),
    "quality_gate": quality_gate,
    "outcomes": outcomes,
    "content_owners": content_owners,
    "source_repeats": source_repeats,
    "first_sources": first_sources,
    "sources_to_do": sources_to_do,
    "sources_to_insert": sources_to_insert,
    "known_content": known_content,
}

_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_W = r"'[^\s\x0b\x1c-\x1f\x85\p{Z}]+'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _single(x: str) -> str:
    return _strip(f"regexp_replace({x}, '{_WS}+', ' ', 'g')")


def _unescape(x: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&#x27;", "''"), ("&#34;", '"'), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def _untag(x: str) -> str:
    return f"regexp_replace({x}, '{X.SOUND_TAGS}', ' ', 'g')"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _grams(w: str) -> str:
    return f"list_transform(range(1, len({w}) - 1), lambda i: array_to_string(list_slice({w}, i, i + 2), ' '))"


_ASCII = r"list_filter(list_transform(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+'), lambda w: w), lambda w: regexp_full_match(w, '[a-zA-Z]{{2,}}'))"
_CLOCK = "printf('%02d:%02d:%02d{mark}%03d', CAST(floor({s} / 3600) AS INT), CAST(floor((floor({s}) % 3600) / 60) AS INT), CAST(floor({s}) % 60 AS INT), CAST(round_even(({s} - floor({s})) * 1000, 0) AS INT))"
_CUES = "list_transform(segments, lambda s, i: {number}" + "{start} || ' --> ' || {end} || chr(10) || coalesce(s.text, '') || chr(10))"


def _clock(s: str, mark: str) -> str:
    return _CLOCK.format(s=s, mark=mark)


def _cues(mark: str, number: str) -> str:
    return _CUES.format(number=number, start=_clock("coalesce(s.start, 0.0)", mark), end=_clock("(coalesce(s.start, 0.0) + coalesce(s.duration, 0.0))", mark))


_TOKENS = f"list_transform(coalesce(segments, []), lambda s: regexp_extract_all({_untag(_unescape('s.text'))}, {_W}))"
_LOW = "list_transform({x}, lambda w: lower(w))"
_OVER = (
    "list_max(list_filter(range(0, 9), lambda k: k <= least(len(acc.prev), len(x), 8) AND "
    "list_transform(list_slice(acc.prev, len(acc.prev) - k + 1, len(acc.prev)), lambda w: lower(w)) = list_transform(list_slice(x, 1, k), lambda w: lower(w))))"
)
_FLICKER = f"""
seg AS (SELECT r.*, {_TOKENS} AS toks FROM (SELECT row_number() OVER () AS rid, * FROM raw_transcript) r),
flick AS (SELECT * EXCLUDE toks, flatten(list_reduce(toks, lambda acc, x:
   CASE WHEN len(x) = 0 OR {_OVER} = len(x) THEN acc
        ELSE {{'out': list_append(acc.out, list_slice(x, {_OVER} + 1, len(x))), 'prev': x}} END,
   {{'out': CAST([] AS VARCHAR[][]), 'prev': CAST([] AS VARCHAR[])}}).out) AS flat FROM seg),
tok AS (SELECT * EXCLUDE flat, CASE WHEN len(coalesce(segments, [])) > 0 THEN coalesce(flat, [])
         ELSE regexp_extract_all({_untag(_unescape("coalesce(raw_text, '')"))}, {_W}) END AS w FROM flick)
"""


def _paragraphs(least: int) -> str:
    """Word by word: a paragraph is closed by a sentence end at or past ``least`` words."""
    return (
        "WITH "
        + _FLICKER
        + f""", para AS (SELECT *, list_reduce(w, lambda acc, x:
   CASE WHEN acc.n + 1 >= {least} AND regexp_matches(x, '[.?!]$')
        THEN {{'n': 0, 't': acc.t || x || chr(10) || chr(10)}} ELSE {{'n': acc.n + 1, 't': acc.t || x || ' '}} END,
   {{'n': 0, 't': ''}}).t AS t FROM tok),
norm AS (SELECT *, regexp_replace(coalesce(t, ''), '[ \n]+$', '') AS text FROM para)
"""
    )


_QUALITY = (
    _paragraphs(150)
    + f""", m AS (SELECT *, regexp_extract_all(text, {_W}) AS ws, length(text) AS chars,
   len(regexp_extract_all(text, '[\\p{{C}}\\p{{Z}}\\x{{fffd}}]')) - len(regexp_extract_all(text, '[ \\n\\r\\t]')) AS abnormal,
   list_avg(list_filter(list_transform(segments, lambda s: s.confidence), lambda c: c IS NOT NULL AND NOT isnan(c))) AS conf FROM norm),
g AS (SELECT *, len(ws) AS n, CASE WHEN len(ws) >= 3 THEN len(ws) - 2 - len(list_distinct({_grams('ws')})) ELSE 0 END AS repeated FROM m),
q AS (SELECT *, n >= 80 AND repeated > (n - 2) * 0.35 AS loops, abnormal > chars * 0.05 AS corrupt FROM g),
z AS (SELECT *, CASE WHEN n = 0 THEN 'EMPTY' WHEN loops OR corrupt THEN 'SUSPICIOUS' WHEN n < 20 OR chars < 100 THEN 'SHORT' ELSE 'GOOD' END AS status FROM q)
"""
)
def _gate_en(base: str = "raw_transcript") -> str:
    return f"""
b AS (SELECT *, {_strip("coalesce(raw_text, '')")} AS x, nullif(coalesce(language_code, ''), '') AS code FROM {base}),
k AS (SELECT *, {_ASCII.format(t="x")} AS toks, len(regexp_extract_all(x, '\\p{{Latin}}')) AS latin, len(regexp_extract_all(x, '\\p{{L}}')) AS letters FROM b),
d AS (SELECT *, CASE WHEN x = '' THEN 'unknown'
   WHEN code IS NOT NULL AND code <> 'unknown' AND split_part(lower(code), '-', 1) <> 'en' THEN code
   WHEN letters > 0 AND latin < letters * 0.8 THEN 'non_latin_script'
   WHEN len(toks) >= 10 AND len(list_filter(toks, lambda w: list_contains({_list(X.HINGLISH_WORDS)}, lower(w)))) > len(toks) * 0.08 THEN 'hinglish'
   WHEN len(toks) >= 20 AND len(list_filter(toks, lambda w: list_contains({_list(X.ENGLISH_WORDS)}, lower(w)))) < len(toks) * 0.1 THEN 'low_english_density'
   ELSE 'en' END AS detected_language, x <> '' AND (code IS NULL OR code = 'unknown' OR split_part(lower(code), '-', 1) = 'en') AS passed FROM k)
"""


ORACLE = {
    "quality_by_language": _QUALITY + "SELECT coalesce(nullif(lower(trim(language_code, ' ')), ''), 'unknown') AS language, status, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_words FROM z GROUP BY 1, 2",
    "text_measures": f"""WITH t AS (SELECT transcript_id, coalesce(raw_text, '') AS x, regexp_extract_all(coalesce(raw_text, ''), {_W}) AS w,
        {_ASCII.format(t="coalesce(raw_text, '')")} AS a FROM raw_transcript)
        SELECT transcript_id, len(w) AS n_words, length({_strip('x')}) AS n_chars,
        len(regexp_extract_all(x, '[\\p{{C}}\\p{{Z}}\\x{{fffd}}]')) - len(regexp_extract_all(x, '[ \\n\\r\\t]')) AS abnormal,
        len(regexp_extract_all(x, '\\p{{L}}')) AS letters, len(a) AS ascii_words,
        len(list_filter(a, lambda w: list_contains({_list(X.ENGLISH_WORDS)}, lower(w)))) AS english_words,
        len(list_filter(a, lambda w: list_contains({_list(X.HINGLISH_WORDS)}, lower(w)))) AS hinglish_words,
        greatest(len(w) - 2, 0) - len(list_distinct({_grams('w')})) AS repeated_grams FROM t""",
    "clean_text": f"SELECT seg_id, regexp_replace({_single(_untag(_unescape('text')))}, '<[^<>]*>', '', 'g') AS text FROM transcript_segment",
    "redacted": "SELECT event_id, 'user ' || user_id || ' sent [REDACTED_SECRET] and [REDACTED_SECRET]' AS line FROM events",
    "file_names": f"""SELECT item_id, CASE WHEN f = '' THEN 'transcript' ELSE left(CASE WHEN list_contains({_list(X.RESERVED_NAMES)}, upper(split_part(f, '.', 1))) THEN 'safe_' || f ELSE f END, 80) END AS file_name
        FROM (SELECT item_id, trim(regexp_replace(regexp_replace(coalesce(nullif(title, ''), source_id), '[\\x00-\\x1f\\\\/*?:"<>|]', '', 'g'), '{_WS}+', '_', 'g'), ' ._') AS f FROM source_item)""",
    "fingerprints": f"SELECT doc_id, sha256(text) AS text_hash, sha256({_single('lower(text)')}) AS canonical_hash, 'doc_' || left(sha256(coalesce(source, '') || chr(31) || coalesce(text, '')), 12) AS stable_id FROM documents",
    "xxhash_groups": f"SELECT n, count(*) AS contents FROM (SELECT {_single('lower(text)')} AS k, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1) GROUP BY 1",
    "deflicker": "WITH " + _FLICKER + "SELECT transcript_id, array_to_string(coalesce(flat, []), ' ') AS text FROM flick WHERE segments IS NOT NULL",
    "paragraphs": _paragraphs(60) + "SELECT transcript_id, text FROM norm",
    "srt_export": f"SELECT transcript_id, array_to_string({_cues(',', 'i || chr(10) || ')}, chr(10)) AS srt FROM raw_transcript WHERE segments IS NOT NULL",
    "vtt_export": f"SELECT transcript_id, array_to_string(list_prepend('WEBVTT' || chr(10), {_cues('.', '')}), chr(10)) AS vtt FROM raw_transcript WHERE segments IS NOT NULL",
    "json_export": "SELECT transcript_id, source_id, language_code AS language, raw_text AS text, CAST(coalesce(len(segments), 0) AS INT) AS n_segments, array_to_string(list_transform(segments, lambda s: concat_ws(' ', CAST(round(s.start * 1000) AS BIGINT), CAST(round((s.start + s.duration) * 1000) AS BIGINT), CASE WHEN s.confidence IS NULL THEN '-' ELSE 'c' END, s.text)), chr(10)) AS cues FROM raw_transcript",
    "subtitle_round_trip": f"""SELECT transcript_id, len(k) AS n, CAST(coalesce(list_sum(list_transform(k, lambda s: CAST(round(s.start * 1000) AS BIGINT))), 0) AS BIGINT) AS start_ms,
        array_to_string(list_transform(k, lambda s: {_single("regexp_replace(s.text, '<[^<>]*>', '', 'g')")}), ' ') AS text
        FROM (SELECT transcript_id, list_filter(segments, lambda s: {_single("regexp_replace(s.text, '<[^<>]*>', '', 'g')")} <> '') AS k FROM raw_transcript WHERE segments IS NOT NULL)""",
    "packed_chunks": f"""WITH s AS (SELECT rid, transcript_id, p, x.start AS a, x.start + x.duration AS z, regexp_extract_all(x.text, {_W}) AS w
           FROM (SELECT rid, transcript_id, unnest(segments) AS x, generate_subscripts(segments, 1) AS p FROM (SELECT row_number() OVER () AS rid, * FROM raw_transcript))),
        r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY p) AS i FROM s WHERE len(w) > 0),
        c AS (WITH RECURSIVE f AS (SELECT rid, i, 0 AS chunk, len(w) AS n FROM r WHERE i = 1
              UNION ALL SELECT r.rid, r.i, CASE WHEN f.n + len(r.w) > 40 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.n + len(r.w) > 40 THEN len(r.w) ELSE f.n + len(r.w) END
              FROM f JOIN r ON r.rid = f.rid AND r.i = f.i + 1) SELECT * FROM f),
        o AS (SELECT rid, transcript_id, chunk, CAST(round(arg_min(a, i) * 1000) AS BIGINT) AS start_ms, CAST(round(arg_max(z, i) * 1000) AS BIGINT) AS end_ms,
              CAST(sum(len(w)) AS INT) AS n_words, string_agg(array_to_string(w, ' '), ' ' ORDER BY i) AS text FROM c JOIN r USING (rid, i) GROUP BY 1, 2, 3)
        SELECT transcript_id, chunk, start_ms, end_ms, n_words, text, sha256(text) AS provenance_hash FROM o""",
    "language_gate_auto": f"""SELECT transcript_id, x <> '' AS is_acceptable, CASE WHEN x = '' THEN 'unknown' ELSE coalesce(nullif(language_code, ''), 'unknown') END AS detected_language,
        CAST(CASE WHEN x = '' THEN 0.0 ELSE 1.0 END AS DOUBLE) AS confidence FROM (SELECT *, {_strip("coalesce(raw_text, '')")} AS x FROM raw_transcript)""",
    "language_gate_en": "WITH " + _gate_en() + """SELECT transcript_id, passed AND detected_language = 'en' AS is_acceptable, detected_language,
        CAST(CASE WHEN x = '' THEN 0.0 WHEN NOT passed THEN 1.0 WHEN detected_language = 'hinglish' THEN 0.9 WHEN detected_language = 'low_english_density' THEN 0.85 ELSE 0.95 END AS DOUBLE) AS confidence FROM d""",
    "language_gate_es": f"""SELECT transcript_id, ok AS is_acceptable, CASE WHEN x = '' THEN 'unknown' ELSE coalesce(nullif(language_code, ''), 'unknown') END AS detected_language,
        CAST(CASE WHEN x = '' THEN 0.0 WHEN ok THEN 1.0 ELSE 0.8 END AS DOUBLE) AS confidence
        FROM (SELECT *, x <> '' AND coalesce(split_part(lower(language_code), '-', 1) = 'es', false) AS ok FROM (SELECT *, {_strip("coalesce(raw_text, '')")} AS x FROM raw_transcript))""",
    "quality_gate": _QUALITY + """SELECT transcript_id, status, status IN ('GOOD', 'SUSPICIOUS') AS is_usable, n AS word_count, CASE WHEN n = 0 THEN 0 ELSE chars END AS character_count,
        coalesce(len(segments), 0) AS segment_count, repeated, CASE WHEN n = 0 THEN 'empty' ELSE array_to_string(list_filter([CASE WHEN n < 20 THEN 'few words' END, CASE WHEN chars < 100 THEN 'few characters' END,
        CASE WHEN loops THEN 'repeated phrases' END, CASE WHEN corrupt THEN 'abnormal characters' END, CASE WHEN conf < 0.5 THEN 'low confidence' END], lambda r: r IS NOT NULL), ', ') END AS reasons FROM z""",
    "outcomes": _QUALITY + ", " + _gate_en("z") + """SELECT CASE WHEN cat IS NULL THEN 'SUCCESS' ELSE 'FAILED' END AS status, cat AS error_category, count(*) AS n
        FROM (SELECT CASE WHEN raw_text IS NULL THEN 'NO_TRANSCRIPT' WHEN NOT (passed AND detected_language = 'en') THEN 'LANGUAGE_MISMATCH'
                          WHEN status NOT IN ('GOOD', 'SUSPICIOUS') THEN 'QUALITY_FAILURE' END AS cat FROM d) GROUP BY 1, 2""",
    "content_owners": f"""SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY {_single('lower(text)')}) END AS owner,
        CASE WHEN text IS NULL OR doc_id = min(doc_id) OVER (PARTITION BY {_single('lower(text)')}) THEN 'UNIQUE' ELSE 'POSSIBLE_DUPLICATE_CONTENT' END AS status FROM documents""",
    "source_repeats": "SELECT item_id, source_id, discovered_at, dense_rank() OVER (PARTITION BY source_id ORDER BY discovered_at NULLS LAST, item_id) > 1 AND source_id IS NOT NULL AS is_repeat FROM source_item",
    "first_sources": "SELECT source_id, min(discovered_at) AS discovered_at FROM source_item GROUP BY 1",
    "sources_to_do": "SELECT DISTINCT source_id, item_id FROM source_item WHERE source_id NOT IN (SELECT source_id FROM raw_transcript WHERE source_id IS NOT NULL)",
    "sources_to_insert": "SELECT source_id, min(discovered_at) AS discovered_at FROM source_item WHERE source_id NOT IN (SELECT source_id FROM transcript_segment WHERE source_id IS NOT NULL) GROUP BY 1",
    "known_content": f"SELECT doc_id FROM documents WHERE collection IS NULL AND {_single('lower(text)')} IN (SELECT {_single('lower(text)')} FROM documents WHERE collection IS NOT NULL AND text IS NOT NULL)",
}
