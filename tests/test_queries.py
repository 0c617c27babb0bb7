"""Every core query runs over the smallest tables, also when they are empty, and equals its SQL where it has one."""

import os

import duckdb
import pandas as pd
import pytest

import oracle_check
from tickloom.plans import registries

FOLDER = "/root/testdata/sf0.001"
QUERIES = {k: q for r in registries() for k, q in r.queries.items()}
SQL = {k: q for r in registries() for k, q in r.sql.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    oracle_check.views(c, FOLDER)
    return c


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for name in os.listdir(FOLDER):
        spark.read.parquet(f"{FOLDER}/{name}").limit(0).write.parquet(str(at / name))
    return str(at)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in SQL:
        cur = con.execute(SQL[name])
        want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description])
        assert sorted(got.columns) == sorted(want.columns) and oracle_check.rows(got) == oracle_check.rows(want)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_over_empty_tables(spark, empty, name):
    QUERIES[name](spark, empty).collect()
