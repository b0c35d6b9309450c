"""Registered streaming queries; the SQL is the batch query that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.session import table
from turnstone.streaming import streams as S


def stream_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.replayed(spark, sf_dir, "events", "ts", ["event_id", "event_type"]).filter("event_id IS NOT NULL")
    return S.run_available(S.first_deliveries(events, "event_id", "ts")).select("event_id", "event_type")


def stream_daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.replayed(spark, sf_dir, "events", "ts", ["event_type", "value"])
    return S.run_available(S.windowed_metrics(events.select("ts", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents")), "ts", "event_type", "cents"))


def stream_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.replayed(spark, sf_dir, "events", "ts", ["user_id"])
    return S.run_available(S.lease_sessions(events, "user_id", "ts", "6 hours"))


def batch_daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("ts", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return S.windowed_metrics(events, "ts", "event_type", "cents")


QUERIES = {"stream_first_deliveries": stream_first_deliveries, "stream_daily_metrics": stream_daily_metrics, "stream_leases": stream_leases, "batch_daily_metrics": batch_daily_metrics}

_DAILY = """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS "from", event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total,
  min(CAST(round(value * 100) AS BIGINT)) AS least, max(CAST(round(value * 100) AS BIGINT)) AS most FROM events GROUP BY 1, 2"""
ORACLE = {
    "stream_first_deliveries": "SELECT DISTINCT event_id, event_type FROM events",
    "stream_daily_metrics": _DAILY,
    "batch_daily_metrics": _DAILY,
    "stream_leases": """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
      n AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
      SELECT user_id, min(ts) AS claimed_at, max(ts) + INTERVAL 6 HOUR AS expired_at, count(*) AS beats, max(ts) AS last_beat FROM n GROUP BY user_id, k""",
}
