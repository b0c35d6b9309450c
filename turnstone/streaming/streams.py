"""Streams of job events: idempotent intake, windowed metrics, leases that run out, keyed upserts.

Everything here is built-in stateful processing in append mode: a window or session comes out once the watermark has
passed it, and its state is dropped. ``run_available`` drains what is there and stops; where the last rows close all
windows before them (``replayed`` adds such a row), a stream's result is that of the batch query.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.operators.catalog import upsert
from turnstone.session import shared_folder


def work_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder (see ``session.shared_folder``)."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A table's files as a stream, in batches of ``files_per_batch``."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    if os.path.isfile(path):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def replayed(spark: SparkSession, sf_dir: str, name: str, at: str, columns: list[str], files: int = 6, after: str = "100 days") -> DataFrame:
    """A table as a stream of ``files`` batches in order of ``at``, and a last row, all null but for ``at``, that closes every window.

    The last row lies ``after`` the others; its own window stays open, so it is in no result.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(at, *columns).withColumn(at, F.col(at).cast("timestamp"))
    folder = f"{work_folder(spark)}/in"
    rows.repartitionByRange(files, at).write.parquet(folder)
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = lambda: sorted(n for f in fs.listStatus(path) if (n := f.getPath().getName()).endswith(".parquet"))
    parts = listed()
    last = spark.read.schema(rows.schema).parquet(folder).agg(F.max(at).alias(at))
    last = last.select((F.col(at) + F.expr(f"INTERVAL {after}")).alias(at), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns])
    last.coalesce(1).write.mode("append").parquet(folder)
    # A file source takes files by their time: the parts in order of their numbers, the closing row last.
    for n, name in enumerate(parts + [x for x in listed() if x not in parts]):
        fs.setTimes(hadoop.Path(f"{folder}/{name}"), 1_700_000_000_000 + 60_000 * n, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def first_deliveries(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, however often it is delivered."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_metrics(stream: DataFrame, at: str, metric: str, value: str, width: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Count, sum, least and most per metric and event-time window; rows later than ``delay`` are dropped."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    window = F.window(at, width, slide) if slide else F.window(at, width)
    out = timed.groupBy(window.alias("w"), metric).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(F.col("w.start").alias("from"), metric, "n", "total", "least", "most")


def lease_sessions(stream: DataFrame, attempt: str, at: str, timeout: str = "60 seconds", delay: str = "1 hour") -> DataFrame:
    """Stretches of heartbeats of an attempt without a pause of ``timeout``; a stretch's end is when its lease ran out."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    out = timed.groupBy(F.session_window(at, timeout).alias("s"), attempt).agg(F.count("*").alias("beats"), F.max(at).alias("last_beat"))
    return out.select(attempt, F.col("s.start").alias("claimed_at"), F.col("s.end").alias("expired_at"), "beats", "last_beat")


def run_available(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Drains a stream into Parquet and reads it back."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark)
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def upsert_stream(stream: DataFrame, path: str, key: str, order: str, checkpoint: str) -> None:
    """Keeps the latest row of every key in a table of generations; a batch that is replayed changes nothing.

    Each batch writes a new generation ``path/g=<batch>`` from the one before, so readers never see half a table. The
    last two generations stay: a replayed batch needs the one before its own.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        old = spark.read.parquet(f"{path}/g={number - 1}") if number else batch.limit(0)
        upsert(old, batch, key, order).write.mode("overwrite").parquet(f"{path}/g={number}")
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/g={number - 2}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
