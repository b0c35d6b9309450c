"""Run summaries and dashboard figures."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_counters(results: DataFrame) -> DataFrame:
    """One row of counts by outcome. ``results``: status, error_category, word_count, character_count, visual_frame_count."""
    ok = F.col("status") == "SUCCESS"
    failed = F.col("status") == "FAILED"
    category = F.coalesce("error_category", F.lit(""))
    language, quality = failed & F.contains(category, F.lit("LANGUAGE")), failed & F.contains(category, F.lit("QUALITY")) & ~F.contains(category, F.lit("LANGUAGE"))
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c).cast("long"))), F.lit(0))
    return results.agg(
        F.count("*").alias("discovered"),
        F.count_if(ok).alias("processed"),
        F.count_if(F.col("status") == "SKIPPED").alias("skipped"),
        F.count_if(language).alias("language_mismatches"),
        F.count_if(quality).alias("quality_failures"),
        F.count_if(failed & ~language & ~quality).alias("failed"),
        total("word_count").alias("total_words"),
        total("character_count").alias("total_characters"),
        total("visual_frame_count").alias("total_visual_frames"),
    )


def breakdowns(results: DataFrame) -> DataFrame:
    """``dimension, value, n`` by source type (all), language and quality (successes): one pass with grouping sets."""
    ok = F.col("status") == "SUCCESS"
    rows = results.select("source_type", F.when(ok, F.col("language")).alias("language"), F.when(ok, F.col("quality_status")).alias("quality_status"))
    sets = rows.groupingSets([["source_type"], ["language"], ["quality_status"]], "source_type", "language", "quality_status")
    out = sets.agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    dimension = F.when(F.col("g") == 3, "source_type").when(F.col("g") == 5, "language").otherwise("quality_status")
    return out.select(dimension.alias("dimension"), F.coalesce("source_type", "language", "quality_status").alias("value"), "n").filter("value IS NOT NULL")


def word_stats(rows: DataFrame, column: str) -> DataFrame:
    """Least, most, mean, median and 90th percentile; exact, between neighbours in proportion; zeros without rows."""
    p = F.percentile(F.col(column), F.array(F.lit(0.5), F.lit(0.9)))
    out = rows.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), p.alias("p"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(F.coalesce(F.col("min").cast("long"), F.lit(0)).alias("min"), F.coalesce(F.col("max").cast("long"), F.lit(0)).alias("max"), F.round(zero(F.col("mean")), 1).alias("mean"), F.round(zero(F.get("p", F.lit(0))), 1).alias("p50"), F.round(zero(F.get("p", F.lit(1))), 1).alias("p90"))


def group_counts(rows: DataFrame, column: str) -> DataFrame:
    """``value, n, percent`` with percent of the largest group; null and empty values are 'unknown'."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))
    counts = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    largest = counts.agg(F.max("n").alias("m"))  # one row
    return counts.join(F.broadcast(largest)).select("value", "n", F.round(F.col("n") * 100 / F.col("m"), 1).alias("percent"))


def totals_or(manifest_total: Column, audited_total: Column) -> Column:
    return F.coalesce(F.nullif(manifest_total, F.lit(0)), audited_total)


def html_report(title: str, counters: dict, bars: dict[str, list[tuple[str, int, float]]], rows: list[dict], most: int = 100) -> str:
    """An offline page from small collected results: counters, bar charts and the first ``most`` manifest rows."""
    esc = lambda x: html.escape(str("" if x is None else x))
    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{esc(title)}</title><style>body{{font-family:sans-serif;margin:2em}}td,th{{padding:.2em .8em;text-align:left}}.bar{{background:#4a7;height:.8em}}</style></head><body><h1>{esc(title)}</h1><table>"]
    parts += [f"<tr><th>{esc(k)}</th><td>{esc(f'{v:,}' if isinstance(v, int) else v)}</td></tr>" for k, v in counters.items()]
    parts.append("</table>")
    for name, values in bars.items():
        parts.append(f"<h2>{esc(name)}</h2><table>")
        parts += [f"<tr><td>{esc(v)}</td><td style='width:20em'><div class='bar' style='width:{p}%'></div></td><td>{n}</td></tr>" for v, n, p in sorted(values, key=lambda x: (-x[1], str(x[0])))]
        parts.append("</table>")
    if rows:
        heads = list(rows[0])
        parts.append("<h2>Records</h2><table><tr>" + "".join(f"<th>{esc(h)}</th>" for h in heads) + "</tr>")
        parts += ["<tr>" + "".join(f"<td>{esc(r.get(h))}</td>" for h in heads) + "</tr>" for r in rows[:most]]
        parts.append("</table>")
    return "".join([*parts, "</body></html>"])
