"""The llm queries over the smallest tables, and over empty ones."""

import os

import duckdb
import pandas as pd
import pytest

import oracle_check
from tickloom.llm.queries import R

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(R.sql))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    oracle_check.views(con, FOLDER)
    cur = con.execute(R.sql[name])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description])
    assert oracle_check.rows(R.queries[name](spark, FOLDER).toPandas()) == oracle_check.rows(want)


@pytest.mark.parametrize("name", sorted(R.queries))
def test_empty_growing_tables(spark, tmp_path, name):
    """The fixed tables stay; the others have no rows."""
    for f in os.listdir(FOLDER):
        df = spark.read.parquet(f"{FOLDER}/{f}")
        fixed = f.startswith(("feature_stat", "mix_target", "content_example"))
        (df if fixed else df.limit(0)).write.parquet(str(tmp_path / f))
    out = R.queries[name](spark, str(tmp_path)).collect()
    assert all(r.tokens == 0 for r in out) if name == "p8_shares" else not out
