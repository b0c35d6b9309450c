"""python -m turnstone.cli: run a registered query, process a dataset, and look after what it wrote."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone import config as settings
from turnstone.session import local_session, table

COMMANDS = {
    "queries": "list the registered queries",
    "query": "show a query's first rows",
    "preview": "show what a run would process, without doing it",
    "process": "run the pipeline and write its results",
    "stats": "show the counters of a run",
    "validate": "compare a written manifest with the texts that are there",
    "health": "show the score of a written dataset",
    "repair": "write the manifest anew from the texts that are there",
    "report": "write an offline HTML page of a written dataset",
    "retry": "list the failures that may be tried again",
    "version": "write an immutable version, or list the versions",
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="turnstone")
    sub = top.add_subparsers(dest="command", required=True)
    for name, text in COMMANDS.items():
        p = sub.add_parser(name, help=text)
        if name == "query":
            p.add_argument("name")
        if name in ("query", "preview", "retry"):
            p.add_argument("--rows", type=int, default=20)
        if name in ("query", "preview", "process", "stats"):
            p.add_argument("--data", required=True, help="folder of the tables")
        if name in ("process", "validate", "health", "repair", "report", "retry", "version"):
            p.add_argument("--out", required=True, help="folder of a dataset")
        if name in ("preview", "process", "stats"):
            p.add_argument("--config")
            p.add_argument("--profile", choices=sorted(settings.PROFILES))
            p.add_argument("--language", default=None)
        if name == "version":
            p.add_argument("--tag", help="without it the versions are listed")
    return top


def _files(manifest: DataFrame) -> DataFrame:
    """The texts of a written dataset as files."""
    return manifest.select(F.col("output_path").alias("path"), F.col("text").alias("content"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("text_hash"))


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    from turnstone.operators import catalog, control, report
    from turnstone.plans import registry

    if a.command == "queries":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    spark = local_session()
    if a.command == "query":
        if a.name not in registry.QUERIES:
            print(f"no query {a.name}")
            return 2
        registry.QUERIES[a.name](spark, a.data).show(a.rows, truncate=80)
        return 0
    if a.command in ("preview", "process", "stats"):
        from turnstone.plans.pipeline import planned, process

        chosen = settings.load(a.config, a.profile, **({"target_language": a.language} if a.language else {}))
        sources, transcripts = table(spark, a.data, "source_item"), table(spark, a.data, "raw_transcript")
        if a.command == "preview":
            planned(sources, transcripts).show(a.rows, truncate=80)
            return 0
        run = process(sources, transcripts, chosen)
        if a.command == "process":
            from turnstone.sinks.files import write_stats

            run.results.write.mode("overwrite").parquet(f"{a.out}/results")
            run.manifest.write.mode("overwrite").parquet(f"{a.out}/manifest")
            run.breakdowns.write.mode("overwrite").json(f"{a.out}/breakdowns")
            write_stats(run.counters, f"{a.out}/stats")
        run.counters.show(vertical=True)
        return 0
    if a.command == "retry":
        failed = spark.read.parquet(f"{a.out}/results").filter("status = 'FAILED'")
        again = control.categories(spark).filter("retryable").withColumnRenamed("category", "error_category")
        failed.join(F.broadcast(again), "error_category").select("source_id", "error_category").show(a.rows, truncate=80)
        return 0
    if a.command == "version" and not a.tag:
        catalog.list_versions(spark, a.out).show(1000, truncate=80)
        return 0
    manifest = spark.read.parquet(f"{a.out}/manifest")
    if a.command == "version":
        print(catalog.snapshot(manifest, a.out, a.tag))
        return 0
    files = _files(manifest)
    findings = catalog.audit(manifest, files)
    if a.command == "validate":
        control.first_details(findings, "finding").show(truncate=False)
        catalog.disk_totals(files).show(vertical=True)
        return 0
    score = catalog.health(findings)
    if a.command == "health":
        score.show(vertical=True)
        return 0 if score.first()["is_healthy"] else 1
    if a.command == "repair":
        catalog.repair(manifest, files.select("path", "content")).write.mode("overwrite").parquet(f"{a.out}/manifest_repaired")
        return 0
    counters = report.run_counters(spark.read.parquet(f"{a.out}/results")).first().asDict()
    bars = {c: [tuple(r) for r in report.group_counts(manifest, c).orderBy(F.desc("n"), "value").limit(50).collect()] for c in ("source_type", "language", "quality_status")}
    rows = [r.asDict() for r in manifest.select("source_id", "title", "language", "quality_status", "word_count").orderBy("source_id").limit(100).collect()]
    page = report.html_report("Dataset", counters, bars, rows)
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/report")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
