"""The job queue, its attempts, artifacts and lineage as tables: every change is a join or an append, applied to whole batches.

A function takes the tables as they are and gives them as they are afterwards; writing them back is a keyed upsert
(``catalog.upsert``), so a batch that is replayed changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone.functions.hashing import stable_id
from turnstone.functions.text import escapes_root
from turnstone.operators.queueing import claim

# States in which a job stays.
TERMINAL = ["COMPLETED", "CANCELLED"]

# Error categories and whether another try may help.
CATEGORIES = [
    ("INVALID_SOURCE", False), ("SOURCE_NOT_FOUND", False), ("MEDIA_CORRUPT", False), ("NO_TRANSCRIPT", False), ("LANGUAGE_MISMATCH", False), ("QUALITY_FAILURE", False), ("STT_ERROR", False), ("FFMPEG_ERROR", False),
    ("RATE_LIMITED", True), ("NETWORK_ERROR", True), ("EXTRACTION_ERROR", False), ("STORAGE_ERROR", False), ("UNKNOWN_ERROR", False),
]


def categories(spark) -> DataFrame:
    """``category, retryable`` of every known error."""
    return spark.createDataFrame(CATEGORIES, "category string, retryable boolean")


def enqueue(jobs: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """``jobs`` (``job_id, state, updated_at`` and others) after requests to queue; COMPLETED jobs and unknown ids stay as they are."""
    wanted = requests.select("job_id").distinct().withColumn("__q", F.lit(True))
    rows = jobs.join(wanted, "job_id", "left")
    queued = F.coalesce("__q", F.lit(False)) & (F.col("state") != "COMPLETED")
    return rows.withColumns({"state": F.when(queued, "QUEUED").otherwise(F.col("state")), "updated_at": F.when(queued, at).otherwise(F.col("updated_at"))}).drop("__q")


def claim_leases(jobs: DataFrame, workers: int, at: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs, attempts) after ``workers`` free workers took a job each: highest priority first, then oldest, then smallest id.

    ``jobs``: ``job_id, state, priority, created_at, attempt_count``. A taken job is ACCEPTED and has one attempt more;
    its attempt holds the lease from ``at`` on.
    """
    order = Window.orderBy(F.desc("priority"), F.asc("created_at"), F.asc("job_id"))  # over at most ``workers`` rows
    taken = claim(jobs, workers=workers).select("job_id", (F.col("attempt_count") + 1).alias("attempt_number"), F.format_string("worker-%04d", F.row_number().over(order)).alias("worker_id"))
    attempts = taken.select(
        stable_id("att_", "job_id", "attempt_number").alias("attempt_id"), "job_id", "attempt_number", "worker_id", at.alias("started_at"), at.alias("heartbeat_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit("ACCEPTED").alias("stage")
    )
    after = jobs.join(taken.select("job_id", F.col("attempt_number").alias("__n")), "job_id", "left")
    after = after.withColumns({"state": F.when(F.col("__n").isNotNull(), "ACCEPTED").otherwise(F.col("state")), "attempt_count": F.coalesce("__n", "attempt_count")}).drop("__n")
    return after, attempts


def heartbeat(attempts: DataFrame, beats: DataFrame) -> DataFrame:
    """``attempts`` with the latest of their heartbeats; completed attempts take none."""
    last = beats.groupBy("attempt_id").agg(F.max("at").alias("__at"))
    rows = attempts.join(last, "attempt_id", "left")
    return rows.withColumn("heartbeat_at", F.when(F.col("completed_at").isNull(), F.greatest("heartbeat_at", "__at")).otherwise(F.col("heartbeat_at"))).drop("__at")


def acknowledge(attempts: DataFrame, jobs: DataFrame, acks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attempts, jobs) after ``acks`` (``attempt_id, final_state, error_category, at``); the last one of an attempt counts.

    An attempt is completed in its final state; its job takes that state and error, of several attempts the last one's.
    Acks of unknown attempts change nothing.
    """
    row = F.struct("at", "final_state", "error_category")
    last = acks.groupBy("attempt_id").agg(F.max(row).alias("__ack"))
    done = attempts.select("attempt_id", "job_id").join(last, "attempt_id")
    after = attempts.join(last, "attempt_id", "left")
    closed = F.col("__ack").isNotNull()
    after = after.withColumns({"completed_at": F.when(closed, F.col("__ack.at")).otherwise(F.col("completed_at")), "stage": F.when(closed, F.col("__ack.final_state")).otherwise(F.col("stage")), "error_category": F.col("__ack.error_category")}).drop("__ack")
    ends = done.groupBy("job_id").agg(F.max(F.struct("__ack.at", "attempt_id", "__ack.final_state", "__ack.error_category")).alias("__end"))
    ended = jobs.join(ends, "job_id", "left")
    ended = ended.withColumns({"state": F.coalesce("__end.final_state", "state"), "error_code": F.col("__end.error_category")}).drop("__end")
    return after, ended


def requeue(jobs: DataFrame, recovered: DataFrame) -> DataFrame:
    """``jobs`` after lost leases (see ``queueing.recover``): back in the queue, or FAILED with MAX_RETRIES_EXCEEDED."""
    worst = recovered.groupBy("job_id").agg(F.min("next_state").alias("__next"))  # FAILED before QUEUED
    rows = jobs.join(worst, "job_id", "left")
    return rows.withColumns({"state": F.coalesce("__next", "state"), "error_code": F.when(F.col("__next") == "FAILED", "MAX_RETRIES_EXCEEDED")}).drop("__next")


def cancel(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """``jobs`` with ``cancelled``: requested jobs are CANCELLED unless they are in a terminal state."""
    wanted = requests.select("job_id").distinct().withColumn("__c", F.lit(True))
    rows = jobs.join(wanted, "job_id", "left")
    hit = F.coalesce("__c", F.lit(False)) & ~F.col("state").isin(TERMINAL)
    return rows.withColumn("cancelled", hit).withColumn("state", F.when(hit, "CANCELLED").otherwise(F.col("state"))).drop("__c")


def illegal_changes(changes: DataFrame, allowed: DataFrame, before: str, after: str) -> DataFrame:
    """Changes of state that the table of ``allowed`` ones (``before, after``) does not hold; staying in a state is no change."""
    edges = allowed.select(F.col("before").alias("__b"), F.col("after").alias("__a")).distinct()
    return changes.filter(F.col(before) != F.col(after)).join(edges, (F.col(before) == F.col("__b")) & (F.col(after) == F.col("__a")), "left_anti")


def depth(jobs: DataFrame, *by: str) -> DataFrame:
    """How many jobs are queued, by any columns."""
    return jobs.filter("state = 'QUEUED'").groupBy(*by).agg(F.count("*").alias("depth"))


def found(rows: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns have the given values; None finds nulls. The conditions reach the scan."""
    for column, value in equal.items():
        rows = rows.filter(F.col(column).isNull() if value is None else F.col(column) == value)
    return rows


def belonging(rows: DataFrame, key: str, owners: DataFrame, owner_key: str) -> DataFrame:
    """Rows of the given owners (artifacts of jobs, projects of organisations), each once."""
    return rows.join(owners.select(F.col(owner_key).alias(key)).distinct(), key, "left_semi")


def lineage(steps: DataFrame, job: str, stage: str, inputs: str, outputs: str, version: str, config: str) -> DataFrame:
    """``id, job_id, stage, input_hashes, output_hashes, pipeline_version, config_hash`` to append: what each step made of what.

    Ids follow from the contents, so a step that is recorded again is the same row.
    """
    joined = lambda c: F.array_join(F.col(c), ",")
    return steps.select(
        stable_id("lin_", job, stage, joined(inputs), joined(outputs)).alias("id"), F.col(job).alias("job_id"), F.col(stage).alias("stage"), F.col(inputs).alias("input_hashes"), F.col(outputs).alias("output_hashes"), F.lit(version).alias("pipeline_version"), F.lit(config).alias("config_hash")
    )


def execution_manifests(jobs: DataFrame, steps: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``execution_id, job_id, status, artifacts, lineage_stages``: a job's run with its artifacts and stages, each sorted.

    ``jobs``: ``job_id, status``; ``steps``: ``job_id, stage, id``; ``artifacts``: ``job_id, artifact_id, content_hash``.
    """
    made = artifacts.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("artifact_id", "content_hash"))).alias("artifacts"))
    done = steps.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("stage", "id"))).alias("lineage_stages"))
    rows = jobs.join(made, "job_id", "left").join(done, "job_id", "left")
    none = lambda df, c: F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c)
    return rows.select(stable_id("exe_", "job_id").alias("execution_id"), "job_id", "status", none(made, "artifacts"), none(done, "lineage_stages"))


def promoted(staged: DataFrame) -> DataFrame:
    """``staged`` (``job_id, path, target, content``) as artifacts: ``artifact_id, job_id, storage_path, content_hash, size_bytes, state``.

    A file that is there, not empty, and goes to a place inside the store is READY; any other is REFUSED, with the reason
    in ``problem``. Contents are hashed whole.
    """
    size = F.octet_length("content")
    problem = F.when(F.col("content").isNull(), "missing").when(size == 0, "empty").when(escapes_root("target"), "outside")
    return staged.select(
        stable_id("art_", "job_id", "target").alias("artifact_id"), "job_id", F.col("target").alias("storage_path"), F.sha2("content", 256).alias("content_hash"), F.coalesce(size, F.lit(0)).alias("size_bytes"), F.when(problem.isNull(), "READY").otherwise("REFUSED").alias("state"), problem.alias("problem")
    )


def first_details(findings: DataFrame, finding: str, most: int = 10) -> DataFrame:
    """``finding, shown, more``: for every kind of finding its first paths and how many more there are.

    The rank limit is applied before the shuffle, so a kind with most of the rows sends ``most`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(finding).orderBy("path"))
    first = findings.select(finding, "path").withColumn("__n", rank).filter(F.col("__n") <= most)
    shown = first.groupBy(finding).agg(F.array_sort(F.collect_list("path")).alias("shown"))
    counts = findings.groupBy(finding).agg(F.count("*").alias("n"))
    return counts.join(shown, finding).select(finding, "shown", F.greatest(F.col("n") - most, F.lit(0)).alias("more"))
