"""The dataset's manifest: upserts, versions, audit against the files, repair, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions.text import word_count


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of every key by ``order``; a new row wins over an old one at the same place.

    One aggregation with map-side combining over both, so a key that is written over and over costs one row per task.
    """
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in rows.columns if c != "__new"]
    rank = F.struct(F.col(order).isNotNull(), F.col(order), "__new", F.xxhash64(*[F.col(c).cast("string") for c in columns]))
    return rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*columns), rank).alias("r")).select("r.*")


def failures(results: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """``key, status, retry_count``: a key's last status and its failures since its last success."""
    won = F.max(F.when(F.col(status) == "SUCCESS", F.col(order))).alias("won")
    base = results.groupBy(key).agg(won, F.max_by(status, order).alias("last_status"))
    after = results.filter(F.col(status) == "FAILED").join(base, key).filter(F.col("won").isNull() | (F.col(order) > F.col("won")))
    counts = after.groupBy(key).agg(F.count("*").alias("retry_count"))
    return base.join(counts, key, "left").select(key, F.col("last_status").alias("status"), F.coalesce("retry_count", F.lit(0)).alias("retry_count"))


def version_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("total_sources"), F.coalesce(F.sum(F.coalesce(F.col("word_count").cast("long"), F.lit(0))), F.lit(0)).alias("total_words"))


def mark_results(processed: DataFrame, failed: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(processed, failed) after a batch of ``results`` (``source_id, status, error_category, output_path, at``).

    ``processed``: ``source_id, output_path, at``; ``failed``: ``source_id, error_category, retry_count, at``. Results
    of a source count in order of ``at``: a success replaces its row and clears its failures, failures after it add to
    the count, with the last one's category.
    """
    ok = F.col("status") == "SUCCESS"
    won = F.max(F.when(ok, F.struct("at", "output_path"))).alias("won")
    each = results.filter(F.col("source_id").isNotNull() & F.col("status").isin("SUCCESS", "FAILED"))
    last = each.groupBy("source_id").agg(won, F.max(F.when(~ok, F.struct("at", "error_category"))).alias("lost"))
    after = each.filter(~ok).join(last.select("source_id", "won"), "source_id").filter(F.col("won").isNull() | (F.col("at") > F.col("won.at")))
    counts = after.groupBy("source_id").agg(F.count("*").alias("n"))
    last = last.join(counts, "source_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    good = processed.join(last.select("source_id", "won"), "source_id", "full")
    good = good.select("source_id", F.coalesce("won.output_path", "output_path").alias("output_path"), F.coalesce("won.at", "at").alias("at")).filter("at IS NOT NULL")
    bad = failed.join(last, "source_id", "full")
    count = F.coalesce("n", F.lit(0)) + F.when(F.col("won").isNull(), F.coalesce("retry_count", F.lit(0))).otherwise(0)
    new = F.coalesce("n", F.lit(0)) > 0
    bad = bad.select("source_id", F.when(new, F.col("lost.error_category")).otherwise(F.col("error_category")).alias("error_category"), count.alias("retry_count"), F.when(new, F.col("lost.at")).otherwise(F.col("at")).alias("at"))
    return good, bad.filter("retry_count > 0")


def version_meta(manifest: DataFrame, tag: str, dataset: str, pipeline_version: str, config_hash: str) -> DataFrame:
    """One row: what a version holds and what made it."""
    named = {"version_tag": tag, "dataset_name": dataset, "pipeline_version": pipeline_version, "config_hash": config_hash}
    return version_totals(manifest).select(*[F.lit(v).alias(k) for k, v in named.items()], "total_sources", "total_words")


def snapshot(manifest: DataFrame, root: str, tag: str, dataset: str = "default_dataset", pipeline_version: str = "1.0.0", config_hash: str = "default_config") -> str:
    """Writes an immutable version, then its metadata; an existing tag is an error."""
    path = f"{root}/versions/{tag}"
    manifest.write.mode("errorifexists").parquet(path)
    spark = manifest.sparkSession
    meta = version_meta(spark.read.schema(manifest.schema).parquet(path), tag, dataset, pipeline_version, config_hash)
    meta.coalesce(1).write.mode("overwrite").json(f"{root}/versions_meta/{tag}")
    return path


def list_versions(spark, root: str) -> DataFrame:
    """``version_tag, dataset_name, total_sources, total_words, pipeline_version, config_hash`` of every snapshot, by name.

    A version without readable metadata has its tag alone.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(f"{root}/versions")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    tags = sorted(s.getPath().getName() for s in fs.listStatus(base) if s.isDirectory()) if fs.exists(base) else []
    rows = spark.createDataFrame([(t,) for t in tags], "version_tag string")
    fields = "version_tag string, dataset_name string, total_sources bigint, total_words bigint, pipeline_version string, config_hash string"
    found = [f"{root}/versions_meta/{t}" for t in tags if fs.exists(hadoop.Path(f"{root}/versions_meta/{t}"))]
    meta = spark.read.schema(fields).json(found) if found else spark.createDataFrame([], fields)
    return rows.join(meta.dropDuplicates(["version_tag"]), "version_tag", "left").orderBy("version_tag")


def disk_totals(files: DataFrame) -> DataFrame:
    """One row: ``files, words, characters`` of the texts that are there and not empty, whatever their hashes."""
    rows = files.filter("content IS NOT NULL AND content <> ''")
    zero = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return rows.agg(F.count("*").alias("files"), zero(word_count("content")).alias("words"), zero(F.length("content")).alias("characters"))


def audit(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``path, finding`` of every manifest row and file: ok, missing, empty, modified or unindexed.

    ``manifest`` has ``output_path, text_hash``; ``files`` has ``path, size, text_hash``.
    """
    m = manifest.filter("output_path IS NOT NULL").select(F.col("output_path").alias("path"), F.col("text_hash").alias("wanted")).groupBy("path").agg(F.max("wanted").alias("wanted"))
    f = files.select(F.col("path").alias("path"), "size", F.col("text_hash").alias("actual"), F.lit(True).alias("there"))
    both = m.withColumn("known", F.lit(True)).join(f, "path", "full")
    finding = F.when(F.col("there").isNull(), "missing").when(F.col("known").isNull(), "unindexed").when(F.col("size") == 0, "empty").when(F.col("wanted").isNotNull() & ~F.col("wanted").eqNullSafe(F.col("actual")), "modified").otherwise("ok")
    return both.select("path", finding.alias("finding"))


def health(findings: DataFrame, n_records: Column | None = None) -> DataFrame:
    """One row: how many of each finding, the score 0..100 and whether all is well (unindexed files aside)."""
    count = lambda *names: F.count_if(F.col("finding").isin(*names))
    row = findings.agg(
        count("ok", "modified").alias("valid"),
        count("missing").alias("missing"),
        count("empty").alias("empty"),
        count("modified").alias("modified"),
        count("unindexed").alias("unindexed"),
        count("frame missing").alias("frames_missing"),
        count("frame empty").alias("frames_empty"),
        count("ok", "modified", "missing", "empty").alias("records"),
    )
    defects = F.expr("20 * missing + 20 * empty + 15 * modified + 5 * frames_missing + 5 * frames_empty")
    score = F.greatest(F.lit(0), 100 - F.floor(defects * 100 / F.greatest("records", F.lit(1)))).cast("int")
    return row.withColumn("score", score).withColumn("is_healthy", defects == 0)


def frame_findings(references: DataFrame, files: DataFrame) -> DataFrame:
    """``path, finding`` of every referenced frame: frame ok, frame missing or frame empty."""
    f = files.select("path", "size").distinct()
    rows = references.filter("path IS NOT NULL AND path <> ''").select("path").join(f, "path", "left")
    return rows.select("path", F.when(F.col("size").isNull(), "frame missing").when(F.col("size") == 0, "frame empty").otherwise("frame ok").alias("finding"))


def repair(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The manifest after repair: rows of files with another hash are refreshed, unknown files get a row of their own.

    ``manifest``: ``source_id, output_path, text_hash, word_count, character_count``; ``files``: ``path, content``.
    Files are matched by base name. Rows without a file stay as they are. ``action``: kept, refreshed or indexed.
    """
    name = lambda c: F.element_at(F.split(F.col(c), r"[/\\]"), -1)
    m = manifest.withColumn("name", name("output_path"))
    f = files.select(name("path").alias("f_name"), "path", F.sha2("content", 256).alias("f_hash"), word_count("content").alias("f_words"), F.length("content").alias("f_chars"))
    both = m.join(f, F.col("name") == F.col("f_name"), "full")
    known = F.col("source_id").isNotNull()
    changed = known & F.col("f_hash").isNotNull() & ~F.col("text_hash").eqNullSafe(F.col("f_hash"))
    fresh = changed | ~known
    return both.select(
        F.coalesce("source_id", F.regexp_replace("f_name", r"\.[^.]*$", "")).alias("source_id"),
        F.coalesce("output_path", "path").alias("output_path"),
        F.when(fresh, F.col("f_hash")).otherwise(F.col("text_hash")).alias("text_hash"),
        F.when(fresh, F.col("f_words")).otherwise(F.col("word_count")).cast("long").alias("word_count"),
        F.when(fresh, F.col("f_chars")).otherwise(F.col("character_count")).cast("long").alias("character_count"),
        F.when(~known, "indexed").when(changed, "refreshed").otherwise("kept").alias("action"),
    )
