"""Pairing each record with the nearest record in time of the same entity.

Both sides are cut into time buckets of an entity and the buckets are hashed into Arrow groups of bounded size; in
each group DuckDB joins backward and forward as of the record's time, and the nearer candidate within the tolerance
is kept. Right-hand rows within the tolerance of a bucket's edge go to the neighbouring bucket too, so no entity,
however large, has to fit into one group.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of both sides that one Arrow group should hold.
GROUP_ROWS = 60_000

_ASOF = """
WITH near AS (SELECT k, t, min(i) AS i FROM r GROUP BY k, t),
back AS (SELECT l.k, l.t, l.i AS li, n.i AS ri, l.t - n.t AS d FROM l ASOF JOIN near n ON l.k = n.k AND l.t >= n.t),
ahead AS (SELECT l.k, l.t, l.i AS li, n.i AS ri, n.t - l.t AS d FROM l ASOF JOIN near n ON l.k = n.k AND l.t <= n.t)
SELECT li, arg_min(ri, (d, side)) AS ri, min(d) AS d
FROM (SELECT *, 0 AS side FROM back UNION ALL SELECT *, 1 AS side FROM ahead) WHERE d <= $tolerance GROUP BY k, t, li
"""


def _micros(column: str):
    c = F.col(f"`{column}`").cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 9e12), F.round(c * 1_000_000).cast("long"))


def groups_for(spark, rows: int) -> int:
    """Arrow groups for so many rows of both sides together."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // GROUP_ROWS))


def nearest_in_time(
    left: DataFrame, right: DataFrame, entity: str, left_id: str, left_time: str, right_id: str, right_time: str, tolerance: float, groups: int | None = None, bucket_seconds: float = 600.0
) -> DataFrame:
    """``left_id, right_id, distance_us``: each left row with its nearest right row at most ``tolerance`` seconds off.

    Times are doubles in seconds, compared as whole microseconds. Rows with a null entity, id or time (NaN and
    infinities included) take no part; left rows with nothing near enough are left out. Between an earlier and a
    later right row at the same distance the earlier wins, among right rows of one time the smallest id. A left id
    that is repeated gives one row per different entity and time, however the groups fall. Right rows of one time
    are folded into one before they are moved. Both tables may be empty, and columns not named are ignored.

    ``groups``: number of Arrow groups; by default from the row counts, ``GROUP_ROWS`` rows each. Where the inputs
    are costly to count, give ``groups_for`` an estimate.
    """
    spark = left.sparkSession
    if groups is None:
        groups = groups_for(spark, left.count() + right.count())
    tol = round(tolerance * 1_000_000)
    width = max(round(bucket_seconds * 1_000_000), 10 * tol, 1)
    le = left.select(F.col(f"`{entity}`").cast("string").alias("e"), F.col(f"`{left_id}`").alias("i"), _micros(left_time).alias("t")).dropna()
    ri = right.select(F.col(f"`{entity}`").cast("string").alias("e"), F.col(f"`{right_id}`").alias("i"), _micros(right_time).alias("t")).dropna()
    ri = ri.groupBy("e", "t").agg(F.min("i").alias("i")).select("e", "i", "t")
    bucket = lambda t: F.floor(t / F.lit(float(width)))
    le = le.withColumn("b", bucket(F.col("t")))
    t = F.col("t")
    ri = ri.withColumn("b", F.explode(F.array_distinct(F.array(bucket(t - tol), bucket(t), bucket(t + tol)))))
    key = F.xxhash64("e", "b")
    le, ri = (x.select(F.pmod(key, F.lit(groups)).cast("int").alias("g"), F.concat_ws("\x00", "e", F.col("b").cast("string")).alias("k"), "i", "t") for x in (le, ri))
    schema = f"`{left_id}` {dict(le.dtypes)['i']}, `{right_id}` {dict(ri.dtypes)['i']}, distance_us bigint"

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "400MB"}) as con:
            con.register("l", a)
            con.register("r", b)
            found = con.sql(_ASOF, params={"tolerance": tol}).to_arrow_table()
        return pa.table([found.column(0).cast(a.schema.field("i").type), found.column(1).cast(b.schema.field("i").type), found.column(2).cast(pa.int64())], names=[left_id, right_id, "distance_us"])

    return le.groupBy("g").cogroup(ri.groupBy("g")).applyInArrow(match, schema)


def frame_source(frame_id: str = "frame_id", source_id: str = "source_id"):
    """The frame's source: its own, or the one that begins its id."""
    return F.coalesce(F.col(source_id), F.regexp_extract(frame_id, r"(?s)^(.*)_[^_]*$", 1))
