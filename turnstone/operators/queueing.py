"""A job queue and its telemetry as tables: order of claims, leases, retries, metrics and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone.functions.timing import backoff


def claim(jobs: DataFrame, state: str = "state", priority: str = "priority", created: str = "created_at", key: str = "job_id", workers: int = 1) -> DataFrame:
    """The queued jobs that ``workers`` free workers take next: highest priority, then oldest, then smallest key."""
    return jobs.filter(F.col(state) == "QUEUED").orderBy(F.desc(priority), F.asc(created), F.asc(key)).limit(workers)


def page(jobs: DataFrame, created: str, key: str, limit: int, offset: int = 0, **equal: object) -> DataFrame:
    """One page of the newest jobs; ``equal`` holds optional column = value conditions."""
    for column, value in equal.items():
        if value is not None:
            jobs = jobs.filter(F.col(column) == value)
    return jobs.orderBy(F.desc(created), F.asc(key)).offset(offset).limit(limit)


def last_heartbeats(beats: DataFrame, attempt: str, at: str) -> DataFrame:
    return beats.groupBy(attempt).agg(F.max(at).alias("heartbeat_at"), F.count("*").alias("beats"))


def recover(attempts: DataFrame, jobs: DataFrame, as_of: Column, timeout_seconds: float, open_states: list[str]) -> DataFrame:
    """``attempt_id, job_id, age_seconds, next_state, next_attempt`` of attempts whose lease ran out by ``as_of``.

    ``attempts``: ``attempt_id, job_id, heartbeat_at, completed_at``; ``jobs``: ``job_id, state, attempt_count,
    max_attempts``. Jobs with attempts left go back to the queue, others fail.
    """
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("heartbeat_at").cast("timestamp"))) / 1e6
    live = attempts.filter("completed_at IS NULL").withColumn("age_seconds", age).filter(F.col("age_seconds") > timeout_seconds)
    both = live.join(jobs.filter(F.col("state").isin(open_states)), "job_id")
    left = F.col("attempt_count") < F.col("max_attempts")
    return both.select("attempt_id", "job_id", "age_seconds", F.when(left, "QUEUED").otherwise("FAILED").alias("next_state"), F.when(left, F.col("attempt_count") + 1).alias("next_attempt"))


def is_transient(category: Column) -> Column:
    # Error categories that may pass when tried again.
    return F.upper(category).isin("RATE_LIMITED", "NETWORK_ERROR", "STT_TIMEOUT", "STORAGE_LOCK_TIMEOUT")


def retries(errors: DataFrame, category: str, attempt: str, most: int = 3) -> DataFrame:
    """``errors`` with ``retry`` and, where it is true, the ``delay_seconds`` before it."""
    again = is_transient(F.col(category)) & (F.col(attempt) < most)
    return errors.withColumn("retry", F.coalesce(again, F.lit(False))).withColumn("delay_seconds", F.when(again, backoff(attempt)))


def recent_metrics(samples: DataFrame, metric: str, at: str, key: str, value: str, last: int = 100) -> DataFrame:
    """Count, mean, least and most of the ``last`` observations of every metric.

    The rank limit is pushed below the shuffle, so a metric with a third of all rows sends ``last`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(metric).orderBy(F.desc(at), F.desc(key)))
    recent = samples.select(metric, at, key, value).withColumn("__rank", rank).filter(F.col("__rank") <= last)
    return recent.groupBy(metric).agg(F.count("*").alias("n"), F.round(F.avg(value), 3).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def usage(facts: DataFrame, at: str, quantity: str, *by: str) -> DataFrame:
    """Sums per month and ``by``."""
    return facts.groupBy(*by, F.date_trunc("month", at).alias("month")).agg(F.sum(quantity).alias("quantity"), F.count("*").alias("records"))


def ranked_pick(rows: DataFrame, entity: str, *preference: Column) -> DataFrame:
    """One row per entity: the first by ``preference``; reduced in the map tasks, without a sort per entity."""
    columns = rows.columns
    return rows.groupBy(F.col(entity).alias("__e")).agg(F.min_by(F.struct(*columns), F.struct(*preference)).alias("r")).select("r.*")
