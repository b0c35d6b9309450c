"""Turning lines of input into source items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.functions import urls as U
from turnstone.functions.text import strip


def listed_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``line`` of every entry of a link list: comments after # and blank lines are left out."""
    line = strip(F.regexp_replace(strip(F.col(column)), r"\s+#.*$", ""))
    return lines.select(line.alias("line")).filter("line <> '' AND line NOT LIKE '#%'")


def routed(lines: DataFrame, column: str) -> DataFrame:
    """``lines`` with ``route``, ``video_id``, ``playlist_id`` and ``link_problem`` of one column."""
    return lines.withColumns({"route": U.route(column), "video_id": U.video_id(column), "playlist_id": U.playlist_id(column), "link_problem": U.link_problem(column)})


def display_name(title: str, path: str, source_id: str):
    """Title, else the file's stem, else the id; empty strings count as missing."""
    stem = F.regexp_extract(F.col(path), r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)
    return F.coalesce(F.nullif(F.col(title), F.lit("")), F.nullif(stem, F.lit("")), F.col(source_id))


def found_in_page(pages: DataFrame, page: str, text: str, pattern: str, limit: int | None = None) -> DataFrame:
    """``page, position, id`` of distinct ids in a page's text, in order of first appearance; at most ``limit`` (1..50)."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))
    if limit is not None:
        found = F.slice(found, 1, max(1, min(50, limit)))
    return pages.select(page, F.posexplode(found).alias("position", "id")).withColumn("position", F.col("position") + 1)


def discovered(lines: DataFrame, column: str, position: str) -> DataFrame:
    """``source_id, route, position``: the sources that lines of input name, each once, where it came first.

    Comments and blank lines are left out; a line that leads nowhere has the route 'unknown' and its own text as id.
    """
    line = strip(F.regexp_replace(strip(F.col(column)), r"\s+#.*$", ""))
    rows = lines.select(line.alias("line"), F.col(position).alias("position")).filter("line <> '' AND line NOT LIKE '#%'")
    ids = F.coalesce(F.when(F.col("route") == "video", F.col("video_id")), F.when(F.col("route") == "playlist", F.col("playlist_id")), F.col("line"))
    return routed(rows, "line").select(ids.alias("source_id"), "route", "position").groupBy("source_id", "route").agg(F.min("position").alias("position"))
