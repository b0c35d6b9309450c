"""All registered queries of the core against their SQL on the smallest tables, and the contract with the driver."""

import os
import subprocess
import sys

import pytest


import __spark_entry__ as entry
from turnstone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, con, name):
    from collections import Counter

    from tools.compare import plain

    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = con.execute(registry.ORACLE[name])
    theirs = [d[0] for d in res.description]
    assert sorted(theirs) == cols
    assert ours == Counter(tuple(plain(r[theirs.index(c)]) for c in cols) for r in res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_the_optional_package():
    code = "import sys; sys.modules['turnstone.llm'] = None; import __spark_entry__ as e; assert 'p6_found' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))
