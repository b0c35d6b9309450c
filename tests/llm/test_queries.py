"""All registered queries of this package on the smallest tables, beside their SQL where they have one."""

from collections import Counter

import duckdb
import glob
import os

import pytest
from pyspark.sql import functions as F

from tools.compare import plain
from turnstone.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": "source_id string, first_seg_id bigint, last_seg_id bigint, speaker_id bigint",
    "p2_found": "frame_id string, seg_id bigint",
    "p3_found": "kind string, id_a bigint, id_b bigint",
    "p4_found": "chunk_id string, cut string",
    "p5_found": "transcript_id bigint, kind string, language string",
    "p7_ids": "doc_id bigint, ids array<int>",
    "p8_found": "source string",
    "p9_found": "doc_id bigint, kind string",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    cols = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert ours
    if name in queries.ORACLE:
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for p in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
        res = con.execute(queries.ORACLE[name])
        theirs = [d[0] for d in res.description]
        assert ours == Counter(tuple(plain(r[theirs.index(c)]) for c in cols) for r in res.fetchall())


def without_ids(spark, folder, name, column):
    """A copy of the tables, with null ids in ``name``."""
    for p in glob.glob(f"{SF}/*.parquet"):
        if os.path.basename(p) != f"{name}.parquet":
            os.symlink(p, folder / os.path.basename(p))
    rows = spark.read.parquet(f"{SF}/{name}.parquet")
    rows = rows.unionByName(rows.limit(5)).withColumn(column, F.lit(None).cast(rows.schema[column].dataType))
    rows.write.parquet(f"{folder}/{name}.parquet")
    return rows


def test_chunks_without_an_id(spark, tmp_path):
    without_ids(spark, tmp_path, "retrieval_chunk", "chunk_id")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW retrieval_chunk AS SELECT * FROM read_parquet('{tmp_path}/retrieval_chunk.parquet/*.parquet')")
    theirs = Counter(con.execute(queries.ORACLE["p4_found"]).fetchall())
    assert sum(theirs.values()) > 1 and Counter(tuple(r) for r in queries.p4_found(spark, str(tmp_path)).collect()) == theirs


def test_transcripts_without_an_id(spark, tmp_path):
    rows = without_ids(spark, tmp_path, "raw_transcript", "transcript_id")
    n = rows.select("language_code", "raw_text").distinct().count()
    assert n > 1 and queries.p5_languages(spark, str(tmp_path)).count() == n
