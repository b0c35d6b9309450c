"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What the library relies on; a cluster's own settings win over these.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").config(map=DEFAULTS)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", memory)
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below the cluster's ``spark.checkpoint.dir``; it is deleted when the application ends.

    Only where that setting is unset and all executors are on this machine (tests) a temporary folder stands in; on a
    cluster every machine would have another one, so there the setting is required.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _TEMPORARY.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="turnstone-")
        _TEMPORARY[context.applicationId] = base
    folder = f"{base.rstrip('/')}/turnstone-{context.applicationId}"
    if folder not in _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _FOLDERS.add(folder)
    return folder


_TEMPORARY: dict[str, str] = {}
_FOLDERS: set[str] = set()


def cut_lineage(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table into the shared folder and go on from there.

    Executors that are lost later cost nothing but a new read. As the table is in files, its real size is known to the
    planner, and later reads take only the columns they need. Its path is added to ``scratch``, for ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, scratch: list[str]) -> None:
    """Delete the tables that ``cut_lineage`` added to ``scratch``; nothing may read them any more."""
    for name in scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    scratch.clear()


def bytes_of(df: DataFrame) -> int:
    """The planner's estimate, which for a table of ``cut_lineage`` is the size of its files; nothing is executed."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when the query ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def spread(df: DataFrame, bytes_per_core: int | None = None) -> DataFrame:
    """``df`` dealt out to all cores if it is small, else as it is.

    A small table is one file and one task; before work that costs far more than moving the rows, an even deal uses
    the whole cluster. The planner's size estimate decides, nothing is executed; rows are the same either way.
    ``bytes_per_core`` is by default the setting ``spark.turnstone.spreadBytesPerCore``; 0 never deals.
    """
    spark = df.sparkSession
    if bytes_per_core is None:
        bytes_per_core = int(spark.conf.get("spark.turnstone.spreadBytesPerCore", str(8 << 20)))
    if not bytes_per_core:
        return df
    cores = spark.sparkContext.defaultParallelism
    size = bytes_of(df)
    return df.repartition(cores) if size < cores * bytes_per_core else df


def current_rows(df: DataFrame, key: str | list[str], version: str = "ingested_at") -> DataFrame:
    """One row per key: the one with the latest ``version`` (nulls are oldest).

    Rows that tie in version are taken to be repeated deliveries; of these the one with the smallest hash stays. A null
    key names nothing: rows with one are told apart by their content, and only alike ones are folded. The rank limit is
    applied before the shuffle too, so repeated keys cost no more than one row per map task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "variant"))])
    nameless = F.lit(False)
    for k in keys:
        nameless = nameless | F.col(f"`{k}`").isNull()
    rank = Window.partitionBy(*keys, F.when(nameless, tie)).orderBy(F.col(version).desc_nulls_last(), tie)
    return df.withColumn("__rank", F.row_number().over(rank)).filter("__rank = 1").drop("__rank")
