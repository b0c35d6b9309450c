"""Registered queries of the interval operator, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.operators.intervals import speaking_periods
from turnstone.session import current_rows, table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "diarization_segment").select("diar_id", "source_id", "speaker", "start", "end", "ingested_at")
    return speaking_periods(current_rows(rows, "diar_id"))


def p6_speaking_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken and silent milliseconds of each speaker, from the merged periods."""
    return (
        p6_found(spark, sf_dir)
        .groupBy("source_id", "speaker")
        .agg(
            F.count_if(F.col("kind") == "period").alias("periods"),
            F.sum(F.when(F.col("kind") == "period", F.expr("end_ms - start_ms")).otherwise(0)).alias("spoken_ms"),
            F.sum(F.when(F.col("kind") == "gap", F.expr("end_ms - start_ms")).otherwise(0)).alias("silent_ms"),
        )
    )


_PERIODS = """
WITH cur AS (
  SELECT * FROM diarization_segment
  QUALIFY row_number() OVER (PARTITION BY diar_id ORDER BY ingested_at DESC NULLS LAST) = 1
), iv AS (
  SELECT source_id, upper(regexp_replace(speaker, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS speaker,
         CAST(round("start" * 1000) AS BIGINT) AS s, CAST(round("end" * 1000) AS BIGINT) AS e
  FROM cur
  WHERE source_id IS NOT NULL AND speaker IS NOT NULL AND isfinite("start") AND isfinite("end")
), marked AS (
  SELECT *, max(e) OVER w AS prev FROM iv WHERE e > s
  WINDOW w AS (PARTITION BY source_id, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), numbered AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END)
              OVER (PARTITION BY source_id, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n
  FROM marked
), periods AS (
  SELECT source_id, speaker, n, min(s) AS start_ms, max(e) AS end_ms FROM numbered GROUP BY ALL
), result AS (
  SELECT source_id, speaker, 'period' AS kind, start_ms, end_ms FROM periods
  UNION ALL
  SELECT * FROM (
    SELECT source_id, speaker, 'gap' AS kind, lag(end_ms) OVER (PARTITION BY source_id, speaker ORDER BY n) AS start_ms,
           start_ms AS end_ms FROM periods
  ) WHERE start_ms IS NOT NULL
)
"""

QUERIES = {"p6_found": p6_found, "p6_speaking_time": p6_speaking_time}

ORACLE = {
    "p6_found": _PERIODS + "SELECT source_id, speaker, kind, start_ms, end_ms FROM result",
    "p6_speaking_time": _PERIODS
    + """SELECT source_id, speaker, count(*) FILTER (WHERE kind = 'period') AS periods,
       CAST(sum(CASE WHEN kind = 'period' THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS spoken_ms,
       CAST(sum(CASE WHEN kind = 'gap' THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS silent_ms
       FROM result GROUP BY 1, 2""",
}
